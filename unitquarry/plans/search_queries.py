"""Search, lookup, comparison and report queries over the store, with their SQL.

The queries of a search are the chunks whose id is divisible by 100, against all rows."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitquarry.functions.text import namespace, truncated
from unitquarry.functions.vectors import norm, normalized, usable
from unitquarry.operators import scopes, search
from unitquarry.sources.tables import table


def asked(chunks):
    return chunks.where("id % 100 = 0").select(F.col("id").alias("query_id"), "library", "embedding")


def _texts(chunks):
    return chunks.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("identifier").alias("text"), "library", F.lit(None).cast("string").alias("version"))


def knn(spark, d):
    c = table(spark, d, "chunks")
    return search.candidates(c, asked(c), k=10)


def knn_multi(spark, d):
    c = table(spark, d, "chunks")
    return search.candidates(c, asked(c), k=5, scoped=False)


def knn_version(spark, d):
    """Each query in its own library and version, with a number of hits of its own, from 1 to 10."""
    c = table(spark, d, "chunks")
    return search.candidates(c, asked(c).join(c.select(F.col("id").alias("query_id"), "version"), "query_id"), k=F.col("query_id") / 100 % 10 + 1)


def fanout_search(spark, d):
    """Each query in the last three versions of its library, newest first, three hits of each."""
    c, r = table(spark, d, "chunks"), table(spark, d, "releases")
    q = scopes.expanded(_texts(c), c.select("library", "version").distinct().join(r, ["library", "version"])).join(asked(c).drop("library"), "query_id")
    return search.fanout(c, q, k=3)


def rerank(spark, d):
    c = table(spark, d, "chunks")
    return search.rerank(c, asked(c), k=10)


def normalize_vec(spark, d):
    v = table(spark, d, "chunks").where(usable(F.col("embedding"), 64))
    n = normalized(F.col("embedding"))
    return v.select("id", F.round(norm(F.col("embedding")), 6).alias("norm"), F.round(F.element_at(n, 1), 6).alias("first"), F.round(F.element_at(n, 64), 6).alias("last"))


def namespaces(spark, d):
    c = table(spark, d, "chunks")
    return c.groupBy("library", "version", namespace(F.col("unit_name")).alias("namespace")).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("unit_name").alias("units"))


def visibility_boost(spark, d):
    c = table(spark, d, "chunks")
    return c.select("id", (F.round(search.visibility_boost(F.col("visibility")) * search.namespace_boost(F.col("unit_name"), search.Ranking()), 6)).alias("boost"))


def named(spark, d):
    """Names to look up: the given searches, and the identifier of every chunk whose id is divisible by 100, in its library and any version."""
    q = table(spark, d, "search_queries").select("query_id", "text", "library", "version")
    own = table(spark, d, "chunks").where("id % 100 = 0").select(F.concat(F.lit("c"), F.col("id").cast("string")), "identifier", "library", F.lit(None).cast("string"))
    return q.unionAll(own)


def lookup_class(spark, d):
    return search.lookup(table(spark, d, "chunks"), named(spark, d))


def find_identifier(spark, d):
    return search.identified(table(spark, d, "chunks"), named(spark, d))


def topk_clamp(spark, d):
    q = table(spark, d, "search_queries")
    return q.select("query_id", scopes.clamped(F.col("top_k")).alias("k"))


def _hits(spark, d, k=5):
    c = table(spark, d, "chunks")
    return search.rerank(c, asked(c), k=k), c


def render_hits(spark, d):
    """Reports of the queries that are chunks, and of the given ones, for which there are no vectors and so no hits."""
    hits, c = _hits(spark, d)
    given = table(spark, d, "search_queries").select(F.col("query_id").cast("string"), "text", "library", "version")
    mine = _texts(c).withColumn("query_id", F.concat(F.lit("c"), F.col("query_id").cast("string")))
    return search.rendered(hits.withColumn("query_id", F.concat(F.lit("c"), F.col("query_id").cast("string"))), c, mine.unionAll(given))


def render_lookup(spark, d):
    c, names = table(spark, d, "chunks"), named(spark, d)
    return search.rendered_lookup(search.lookup(c, names), c, names)


def compare_detailed(spark, d):
    hits, c = _hits(spark, d)
    meta = c.select("id", "library", "version", "unit_name", "identifier", truncated(F.coalesce("content", F.lit("")), 120).alias("head"))
    return hits.join(meta, "id").select("query_id", "rank", "library", "version", "unit_name", "identifier", "head")


def _last_two(spark, d):
    """The two versions of each library that were delivered last: turn 1 and 2."""
    c, r = table(spark, d, "chunks"), table(spark, d, "releases")
    there = c.select("library", "version").distinct().join(r, ["library", "version"])
    order = Window.partitionBy("library").orderBy(F.col("released_at").desc())
    return there.withColumn("turn", F.row_number().over(order)).where("turn <= 2").select("library", "version", "turn")


def compare_overlap(spark, d):
    """Of each library's hits in its last two versions, how many have the same natural key."""
    c = table(spark, d, "chunks")
    turns = _last_two(spark, d)
    q = asked(c)
    both = []
    for turn in (1, 2):
        own = c.join(turns.where(F.col("turn") == turn).drop("turn"), ["library", "version"], "left_semi")
        near = search.candidates(own, q, k=5).join(own.select("id", F.lower("unit_name").alias("u"), F.lower("identifier").alias("i"), "chunk_type"), "id")
        both.append(near.select("query_id", "u", "i", "chunk_type").distinct())
    same = both[0].join(both[1], ["query_id", "u", "i", "chunk_type"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("shared"))
    return q.where(usable(F.col("embedding"), 64)).select("query_id").join(same, "query_id", "left").select("query_id", F.coalesce("shared", F.lit(0)).alias("shared"))


def compare_summary(spark, d):
    """Of each library, the queries compared and the average share of the five hits of its last two versions with the same natural key, in percent."""
    c = table(spark, d, "chunks")
    each = compare_overlap(spark, d).join(c.select(F.col("id").alias("query_id"), "library"), "query_id")
    return each.groupBy("library").agg(F.count(F.lit(1)).alias("queries"), F.format_string("%.1f", F.round(F.sum("shared") * 100 / (F.count(F.lit(1)) * 5), 1)).alias("average"))


def compare_markdown(spark, d):
    """The hits of each query in the last two versions of its library, as lists."""
    c = table(spark, d, "chunks")
    q = asked(c).join(_last_two(spark, d), "library").withColumn("query_id", F.struct("query_id", "turn"))
    out = search.compared(search.rerank(c, q, k=5), c)
    return out.select("query_id.query_id", "query_id.turn", "version", "markdown")


def compare_blocks(spark, d):
    """The declarations of each class that is a query in the last two versions of its library, one block a version, newest first."""
    c = table(spark, d, "chunks")
    turns = _last_two(spark, d)
    names = _texts(c.where("chunk_type = 'type'")).drop("version").join(turns, "library").select(F.struct("query_id", "turn").alias("query_id"), "text", "library", "version")
    each = search.rendered_lookup(search.lookup(c, names), c, names).join(names.select("query_id", "version"), "query_id")
    block = F.concat(F.lit("=== Version "), F.col("version"), F.lit(" ===\n"), F.col("report"))
    return each.groupBy("query_id.query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_id.turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("report"))


def compare_versions(spark, d):
    """Each class of a library's last two versions side by side: its longest chunk in either, and whether they agree."""
    c = table(spark, d, "chunks").where("chunk_type = 'type'").join(_last_two(spark, d), ["library", "version"])
    size = F.coalesce(F.length("content"), F.lit(0)).cast("bigint")
    one = c.groupBy("library", F.lower("identifier").alias("identifier"), "turn").agg(F.max(size).alias("size"))
    pick = lambda t: F.max(F.when(F.col("turn") == t, F.col("size")))
    return one.groupBy("library", "identifier").agg(pick(1).alias("newer"), pick(2).alias("older"))


QUERIES = {
    f.__name__: f
    for f in (knn, knn_multi, knn_version, fanout_search, rerank, normalize_vec, namespaces, visibility_boost, lookup_class, find_identifier, topk_clamp, render_hits, render_lookup, compare_detailed, compare_markdown, compare_blocks, compare_overlap, compare_summary, compare_versions)
}

_V = """
v AS (SELECT id, library, version, unit_name, visibility, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunks WHERE len(embedding) = 64),
n AS (SELECT * EXCLUDE (e), list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0)"""
_NEAR = "round(1 - list_dot_product(q.e, c.e), 6) + 0.0"


def _ranked(k: int, scoped: bool = True, extra: str = "") -> str:
    on = "q.library = c.library" if scoped else "true"
    return f"""{_V},
s AS (SELECT q.id AS query_id, c.id, {_NEAR} AS base_distance FROM n q JOIN n c ON {on} {extra} WHERE q.id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base_distance, id) AS base_rank FROM s QUALIFY base_rank <= {k})"""


_BOOST = "(CASE lower(visibility) WHEN 'published' THEN 0.94 WHEN 'protected' THEN 1.02 WHEN 'private' THEN 1.05 ELSE 0.97 END)::DOUBLE"
_SPACE = "CASE WHEN instr(unit_name, '.') > 1 THEN split_part(unit_name, '.', 1) ELSE unit_name END"
_FIRST = f"(CASE WHEN {_SPACE} IN ('System', 'Vcl', 'FMX', 'FireDAC') THEN 0.95 ELSE 1.0 END)::DOUBLE"


def _reranked(k: int) -> str:
    return f"""{_ranked(k * 5)},
b AS (SELECT k.*, round(base_distance * {_FIRST} * {_BOOST}, 9) AS distance FROM k JOIN chunks USING (id)),
h AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, base_rank) AS rank, id, base_distance, distance FROM b QUALIFY rank <= {k})"""


_FANOUT = f"""d AS (SELECT library, version, row_number() OVER (PARTITION BY lower(library) ORDER BY released_at DESC NULLS LAST, version) AS pos
  FROM releases SEMI JOIN chunks USING (library, version) QUALIFY pos <= 3), {_V},
s AS (SELECT q.id AS query_id, pos, c.id, {_NEAR} AS base_distance, c.unit_name, c.visibility FROM n q JOIN d ON lower(d.library) = lower(q.library) JOIN n c ON c.library = q.library AND c.version = d.version WHERE q.id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, pos ORDER BY base_distance, id) AS base_rank FROM s QUALIFY base_rank <= 15),
b AS (SELECT *, round(base_distance * {_FIRST} * {_BOOST}, 9) AS distance FROM k)
SELECT query_id, pos, row_number() OVER (PARTITION BY query_id, pos ORDER BY distance, base_rank) AS rank, id, base_distance, distance FROM b QUALIFY rank <= 3"""
_MISSING = "'No relevant ' || coalesce({q}library, '') || ' source found for that query' || coalesce(' (version ' || {q}version || ').', '.')"
_NAMED = "q AS (SELECT query_id, text, library, version FROM search_queries UNION ALL SELECT 'c' || id, identifier, library, NULL FROM chunks WHERE id % 100 = 0)"
_HEAD = "CASE WHEN length(coalesce(content, '')) > 120 THEN substr(content, 1, 120) || '...' ELSE coalesce(content, '') END"
_TURNS = """t AS (SELECT library, version, row_number() OVER (PARTITION BY library ORDER BY released_at DESC) AS turn FROM releases SEMI JOIN chunks USING (library, version) QUALIFY turn <= 2)"""
_LONGEST = """m AS (SELECT query_id, c.id, length(content) AS size FROM q JOIN chunks c ON c.identifier = q.text AND c.chunk_type = 'type'
  AND (q.library IS NULL OR q.library = c.library) AND (q.version IS NULL OR q.version = c.version)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY size DESC NULLS LAST, c.id) = 1)"""
_DECLARED = """'--- ' || coalesce(c.unit_name, '') || '.' || coalesce(q.text, '') || ' (' || coalesce(c.library, '') || ' ' || coalesce(c.version, '') || ', type declaration, visibility ' || coalesce(c.visibility, 'public')
  || ') ---' || chr(10) || coalesce(c.content, '') || chr(10)"""
_OVERLAP = f"""{_V}, {_TURNS},
s AS (SELECT q.id AS query_id, turn, c.id, {_NEAR} AS dist FROM n q JOIN n c ON q.library = c.library JOIN t ON t.library = c.library AND t.version = c.version WHERE q.id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY q.id, turn ORDER BY dist, c.id) <= 5),
u AS (SELECT DISTINCT query_id, turn, lower(unit_name) AS u, lower(identifier) AS i, chunk_type FROM s JOIN chunks USING (id)),
x AS (SELECT a.query_id, count(*) AS shared FROM u a JOIN u b ON a.query_id = b.query_id AND a.turn = 1 AND b.turn = 2 AND a.u = b.u AND a.i = b.i AND a.chunk_type = b.chunk_type GROUP BY ALL),
o AS (SELECT n.id AS query_id, n.library, coalesce(shared, 0) AS shared FROM n LEFT JOIN x ON x.query_id = n.id WHERE n.id % 100 = 0 AND n.library IS NOT NULL)"""
ORACLE = {
    "knn": f"WITH {_ranked(10)} SELECT * FROM k",
    "knn_multi": f"WITH {_ranked(5, False)} SELECT * FROM k",
    "rerank": f"WITH {_reranked(10)} SELECT * FROM h",
    "normalize_vec": f"WITH {_V} SELECT v.id, round(sqrt(list_dot_product(v.e, v.e)), 6) AS norm, round(n.e[1], 6) AS first, round(n.e[64], 6) AS last FROM n JOIN v USING (id)",
    "namespaces": f"SELECT library, version, {_SPACE} AS namespace, count(*) AS chunks, count(DISTINCT unit_name) AS units FROM chunks GROUP BY ALL",
    "visibility_boost": f"SELECT id, round({_BOOST} * {_FIRST}, 6) AS boost FROM chunks",
    "lookup_class": f"WITH {_NAMED}, {_LONGEST} SELECT query_id, id IS NOT NULL AS found, id, size FROM q LEFT JOIN m USING (query_id)",
    "find_identifier": f"""WITH {_NAMED} SELECT query_id, c.id, chunk_type FROM q JOIN chunks c ON c.identifier = q.text
  AND (q.library IS NULL OR q.library = c.library) AND (q.version IS NULL OR q.version = c.version)""",
    "topk_clamp": "SELECT query_id, greatest(1, least(10, coalesce(top_k, 5)))::INTEGER AS k FROM search_queries",
    "knn_version": f"""WITH {_ranked(10, True, 'AND q.version = c.version')} SELECT * FROM k WHERE base_rank <= query_id // 100 % 10 + 1""",
    "fanout_search": f"WITH {_FANOUT}",
    "render_hits": f"""WITH {_reranked(5)}, t AS (SELECT query_id, count(*) AS n, string_agg('--- [' || rank || '] ' || coalesce(unit_name, '') || '.' || coalesce(identifier, '') || ' (' || coalesce(chunk_type, '') || ', '
  || coalesce(section, '') || ', visibility ' || coalesce(visibility, 'public') || ', ' || coalesce(library, '') || ' ' || coalesce(version, '') || ', line ' || coalesce(start_line::VARCHAR, '') || ') [distance: '
  || printf('%.4f', round(distance, 4)) || '] ---' || chr(10) || coalesce(content, '') || chr(10), chr(10) ORDER BY rank) AS b FROM h JOIN chunks USING (id) GROUP BY query_id),
q AS (SELECT 'c' || id AS query_id, id, identifier AS text, library, NULL::VARCHAR AS version FROM chunks WHERE id % 100 = 0 UNION ALL SELECT query_id, NULL, text, library, version FROM search_queries)
SELECT q.query_id, CASE WHEN b IS NULL THEN {_MISSING.format(q='q.')} ELSE 'Found ' || n || ' relevant ' || coalesce(library, '') || ' chunks for: "' || coalesce(text, '') || '"' || chr(10) || chr(10) || b END AS report FROM q LEFT JOIN t ON t.query_id = q.id""",
    "render_lookup": f"""WITH {_NAMED}, {_LONGEST}
SELECT q.query_id, CASE WHEN m.id IS NULL THEN {_MISSING.format(q='q.')} ELSE {_DECLARED} END AS report FROM q LEFT JOIN m USING (query_id) LEFT JOIN chunks c ON c.id = m.id""",
    "compare_blocks": f"""WITH {_TURNS}, q AS (SELECT c.id || ' ' || turn AS query_id, c.id AS of, turn, c.identifier AS text, library, t.version FROM chunks c JOIN t USING (library) WHERE c.id % 100 = 0 AND chunk_type = 'type'), {_LONGEST},
r AS (SELECT of, turn, '=== Version ' || q.version || ' ===' || chr(10) || CASE WHEN m.id IS NULL THEN {_MISSING.format(q='q.')} ELSE {_DECLARED} END AS b FROM q LEFT JOIN m USING (query_id) LEFT JOIN chunks c ON c.id = m.id)
SELECT of AS query_id, string_agg(b, chr(10) || chr(10) ORDER BY turn) AS report FROM r GROUP BY of""",
    "compare_markdown": f"""WITH {_V}, {_TURNS},
s AS (SELECT q.id AS query_id, turn, t.version, c.id, {_NEAR} AS base_distance, c.unit_name, c.visibility FROM n q JOIN t ON t.library = q.library JOIN n c ON c.library = q.library AND c.version = t.version WHERE q.id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, turn ORDER BY base_distance, id) AS base_rank FROM s QUALIFY base_rank <= 25),
b AS (SELECT *, round(base_distance * {_FIRST} * {_BOOST}, 9) AS distance FROM k),
h AS (SELECT query_id, turn, version, id, distance, row_number() OVER (PARTITION BY query_id, turn ORDER BY distance, base_rank) AS rank FROM b QUALIFY rank <= 5)
SELECT query_id, turn, h.version, '### ' || h.version || ' Results:' || chr(10) || string_agg('**Rank ' || rank || '** (dist=' || printf('%.4f', round(distance, 4)) || ')' || chr(10) || '- Unit: `' || coalesce(unit_name, '') || '`' || chr(10)
  || '- Section: ' || coalesce(section, '') || chr(10) || '- Identifier: `' || coalesce(identifier, '') || '`' || chr(10) || '- Line: ' || coalesce(start_line::VARCHAR, '') || chr(10) || '- Content: ' || {_HEAD} || chr(10), chr(10) ORDER BY rank) AS markdown
FROM h JOIN chunks c USING (id) GROUP BY query_id, turn, h.version""",
    "compare_detailed": f"WITH {_reranked(5)} SELECT query_id, rank, library, version, unit_name, identifier, {_HEAD} AS head FROM h JOIN chunks USING (id)",
    "compare_overlap": f"WITH {_OVERLAP} SELECT query_id, shared FROM o",
    "compare_summary": f"WITH {_OVERLAP} SELECT library, count(*) AS queries, printf('%.1f', round(sum(shared) * 100 / (count(*) * 5), 1)) AS average FROM o GROUP BY library",
    "compare_versions": f"""WITH {_TURNS}, o AS (SELECT library, lower(identifier) AS identifier, turn, coalesce(length(content), 0) AS size FROM chunks JOIN t USING (library, version) WHERE chunk_type = 'type')
SELECT library, identifier, max(size) FILTER (turn = 1) AS newer, max(size) FILTER (turn = 2) AS older FROM o GROUP BY ALL""",
}
