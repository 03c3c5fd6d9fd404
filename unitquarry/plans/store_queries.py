"""Queries on the store's scopes and on diagnostics, with their SQL."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitquarry.functions.text import split_list
from unitquarry.functions.vectors import norm
from unitquarry.operators import diagnostics, scopes, store
from unitquarry.session import scratch
from unitquarry.sources.tables import table


def count_chunks(spark, d):
    return store.counts(table(spark, d, "chunks"))


def list_versions(spark, d):
    """Every listed version with the number of its chunks, in the order of release."""
    r = table(spark, d, "releases")
    order = Window.partitionBy("library").orderBy(F.col("released_at").asc_nulls_first(), "version")
    listed = r.withColumn("pos", F.row_number().over(order).cast("bigint"))
    return listed.join(store.counts(table(spark, d, "chunks")), ["library", "version"], "left").select("library", "version", "channel", "pos", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def store_roundtrip(spark, d):
    """Each scope of a store that all chunks were appended to and that was compacted then, as it is read back."""
    path, to = scratch(spark), scratch(spark)
    store.append(table(spark, d, "chunks"), path)
    store.compact(spark, path, to)
    back = store.read(spark, to)
    return back.groupBy("library", "version").agg(F.count(F.lit(1)).alias("chunks"), F.min("id").alias("first"), F.max("id").alias("last"), F.sum(F.length("content")).cast("bigint").alias("size"), F.count("embedding").alias("vectors"))


def schema_evolve(spark, d):
    """The visibilities of a store to which chunks with odd ids were added before it had that column."""
    path, c = scratch(spark), table(spark, d, "chunks")
    store.append(c.where("id % 2 = 1").drop("visibility", "indexed_at"), path)
    store.append(c.where("id % 2 = 0"), path)
    return store.read(spark, path).groupBy("library", "version", "visibility").agg(F.count(F.lit(1)).alias("chunks"))


def sample_embedding(spark, d):
    first = store.first_embedding(table(spark, d, "chunks"))
    return first.select("library", "version", "id", F.round(norm(F.col("embedding")), 6).alias("norm"))


def _scopes(spark, d):
    p = table(spark, d, "profile_scopes").where("enabled")
    return p.select(F.lower(F.trim("library")).alias("library"), F.trim("version").alias("version")).where("library is not null and version is not null").distinct()


def scan_scope(spark, d):
    """The chunks in any scope of an enabled profile."""
    c, s = table(spark, d, "chunks"), _scopes(spark, d)
    return c.join(s, (F.lower(c["library"]) == s["library"]) & (c["version"] == s["version"]), "left_semi").select("id", "library", "version", "unit_name")


def delete_scope(spark, d):
    """What is left of each scope when those of the profiles are deleted."""
    c, s = table(spark, d, "chunks"), _scopes(spark, d)
    return store.counts(store.delete_scope(c, s))


def scope_group(spark, d):
    g = scopes.grouped(table(spark, d, "profile_scopes"))
    return g.select("profile_id", "library", "pos", F.array_join("versions", ",").alias("versions"))


def scope_expand(spark, d):
    c, r = table(spark, d, "chunks"), table(spark, d, "releases")
    return scopes.expanded(table(spark, d, "search_queries"), c.select("library", "version").distinct().join(r, ["library", "version"]))


def scope_limits(spark, d):
    """Profiles with the number of their libraries and scopes, and the most versions of one library."""
    g = scopes.grouped(table(spark, d, "profile_scopes"))
    return g.groupBy("profile_id").agg(F.count(F.lit(1)).alias("libraries"), F.sum(F.size("versions")).cast("bigint").alias("scopes"), F.max(F.size("versions")).cast("bigint").alias("most"))


def profile_limits(spark, d):
    """The effective limit of each scope of an enabled profile, for a query that asks for 99."""
    return table(spark, d, "profile_scopes").where("enabled").select("profile_id", "scope_no", scopes.clamped(F.lit(99), F.coalesce("max_top_k", F.lit(10))).alias("k"))


def fanout_lookup(spark, d):
    """The chunks of each name, that of every chunk whose id is divisible by 100, in the last three versions of its library, newest first; scopes without any are left out."""
    c, r = table(spark, d, "chunks"), table(spark, d, "releases")
    names = c.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("identifier").alias("text"), "library", F.lit(None).cast("string").alias("version"))
    q = scopes.expanded(names, c.select("library", "version").distinct().join(r, ["library", "version"])).join(names.select("query_id", "text"), "query_id").withColumn("l", F.lower("library"))
    per = c.groupBy(F.lower("library").alias("l"), "version", F.col("identifier").alias("text")).agg(F.count(F.lit(1)).alias("hits"))
    return q.join(per, ["text", "l", "version"]).select("query_id", "library", "version", "pos", "hits")


def parse_versions(spark, d):
    """The versions of each library as one list in text form, and taken apart again."""
    r = table(spark, d, "releases")
    whole = r.groupBy("library").agg(F.array_join(F.array_sort(F.collect_set("version")), " , ").alias("text"))
    return whole.select("library", F.explode(split_list(F.col("text"))).alias("version"))


def diag_dedupe(spark, d):
    return diagnostics.distinct(table(spark, d, "parse_diagnostics"))


def diag_order(spark, d):
    return diagnostics.ordered(table(spark, d, "parse_diagnostics")).select("file_id", "pos", "code", "severity", "start_line", "start_column")


def diag_report(spark, d):
    return diagnostics.report(table(spark, d, "parse_diagnostics"))


QUERIES = {
    f.__name__: f
    for f in (count_chunks, list_versions, store_roundtrip, schema_evolve, sample_embedding, scan_scope, delete_scope, scope_group, scope_expand, scope_limits, profile_limits, fanout_lookup, parse_versions, diag_dedupe, diag_order, diag_report)
}

_SCOPES = "s AS (SELECT DISTINCT lower(trim(library)) AS l, trim(version) AS v FROM profile_scopes WHERE enabled AND library IS NOT NULL AND version IS NOT NULL)"
_GROUPED = """f AS (SELECT profile_id, lower(trim(library)) AS l, lower(trim(version)) AS v, min(scope_no) AS n, arg_min(trim(library), scope_no) AS library, arg_min(trim(version), scope_no) AS version
  FROM profile_scopes WHERE trim(library) <> '' AND trim(version) <> '' GROUP BY ALL),
g AS (SELECT profile_id, l, arg_min(library, n) AS library, min(n)::BIGINT AS pos, list(version ORDER BY n) AS versions FROM f GROUP BY ALL)"""
_EXPANDED = """d AS (SELECT library, version, row_number() OVER (PARTITION BY lower(library) ORDER BY released_at DESC NULLS LAST, version) AS pos
  FROM releases SEMI JOIN chunks USING (library, version) QUALIFY pos <= 3),
q AS (SELECT query_id, text, CASE WHEN trim(library) <> '' THEN trim(library) END AS library, CASE WHEN trim(version) <> '' THEN trim(version) END AS version FROM search_queries),
e AS (SELECT query_id, text, library, version, 1::BIGINT AS pos FROM q WHERE library IS NOT NULL AND version IS NOT NULL
  UNION ALL SELECT query_id, text, q.library, d.version, d.pos FROM q JOIN d ON lower(q.library) = lower(d.library) WHERE q.version IS NULL
  UNION ALL SELECT query_id, text, d.library, d.version, d.pos FROM q, d WHERE q.library IS NULL AND d.pos = 1)"""
_DISTINCT = """k AS (SELECT file_id, coalesce(code, '') AS code, upper(left(severity, 1)) || lower(substr(severity, 2)) AS severity, coalesce(message, '') AS message, span.start_line, span.start_column, span.end_line, span.end_column,
  coalesce(recovery_hint, '') AS hint, count(*) AS repeats FROM parse_diagnostics GROUP BY ALL)"""
ORACLE = {
    "count_chunks": "SELECT library, version, count(*) AS chunks FROM chunks GROUP BY ALL",
    "list_versions": """WITH c AS (SELECT library, version, count(*) AS chunks FROM chunks GROUP BY ALL)
SELECT library, version, channel, row_number() OVER (PARTITION BY library ORDER BY released_at NULLS FIRST, version) AS pos, coalesce(chunks, 0) AS chunks FROM releases LEFT JOIN c USING (library, version)""",
    "store_roundtrip": "SELECT library, version, count(*) AS chunks, min(id) AS first, max(id) AS last, sum(length(content))::BIGINT AS size, count(embedding) AS vectors FROM chunks GROUP BY ALL",
    "schema_evolve": "SELECT library, version, CASE WHEN id % 2 = 0 THEN visibility END AS visibility, count(*) AS chunks FROM chunks GROUP BY ALL",
    "sample_embedding": """SELECT library, version, id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM chunks
QUALIFY row_number() OVER (PARTITION BY library, version ORDER BY id) = 1""",
    "scan_scope": f"WITH {_SCOPES} SELECT id, library, version, unit_name FROM chunks SEMI JOIN s ON lower(library) = l AND version = v",
    "delete_scope": f"WITH {_SCOPES} SELECT library, version, count(*) AS chunks FROM chunks ANTI JOIN s ON library = l AND version = v GROUP BY ALL",
    "scope_group": f"WITH {_GROUPED} SELECT profile_id, library, pos, array_to_string(versions, ',') AS versions FROM g",
    "scope_expand": f"WITH {_EXPANDED} SELECT query_id, library, version, pos FROM e",
    "scope_limits": f"WITH {_GROUPED} SELECT profile_id, count(*) AS libraries, sum(len(versions))::BIGINT AS scopes, max(len(versions)) AS most FROM g GROUP BY ALL",
    "profile_limits": "SELECT profile_id, scope_no, greatest(1, least(10, least(99, coalesce(max_top_k, 10))))::INTEGER AS k FROM profile_scopes WHERE enabled",
    "fanout_lookup": f"""WITH {_EXPANDED.split("q AS (")[0]} e AS (SELECT c.id AS query_id, c.identifier AS text, c.library, d.version, d.pos FROM chunks c JOIN d ON lower(c.library) = lower(d.library) WHERE c.id % 100 = 0), c AS (SELECT lower(library) AS l, version AS v, identifier, count(*) AS hits FROM chunks GROUP BY ALL)
SELECT query_id, library, version, pos, hits FROM e JOIN c ON identifier = text AND l = lower(library) AND v = version""",
    "parse_versions": "SELECT DISTINCT library, version FROM releases",
    "diag_dedupe": f"WITH {_DISTINCT} SELECT * FROM k",
    "diag_order": f"""WITH {_DISTINCT} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY CASE severity WHEN 'Error' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Info' THEN 2 ELSE 3 END,
  start_line NULLS FIRST, start_column NULLS FIRST, code, message, end_line NULLS FIRST, end_column NULLS FIRST, hint) AS pos, code, severity, start_line, start_column FROM k QUALIFY pos <= 500""",
    "diag_report": f"""WITH {_DISTINCT} SELECT file_id, count(*) AS total, least(count(*), 500) AS returned, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings,
  count(*) FILTER (severity = 'Info') AS infos, count(*) > 500 AS truncated FROM k GROUP BY file_id""",
}
