"""Exact nearest-neighbour search, re-ranking, and lookup by name, for many queries in one job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from pyspark.sql.window import Window

from unitquarry.functions.text import namespace, truncated
from unitquarry.functions.vectors import usable

# Namespaces that come first, and factors on the distance.
NAMESPACES = ("System", "Vcl", "FMX", "FireDAC")
NAMESPACE_BOOST = 0.95
VISIBILITY_BOOST = {"published": 0.94, "public": 0.97, "protected": 1.02, "private": 1.05}
#: Queries that are sent to all tasks at once, or of a block, at most; bytes of the vectors of a slice; queries and chunks that are multiplied at a time.
QUERY_BLOCK, SLICE_BYTES, STEP = 4096, 8 << 20, 2048


@dataclass(frozen=True)
class Ranking:
    namespaces: Sequence[str] = NAMESPACES
    boost: float = NAMESPACE_BOOST
    oversample: int = 5


def visibility_boost(visibility: Column) -> Column:
    """The factor of a visibility in any case; null, empty and unknown ones count as public."""
    low, out = F.lower(visibility), F.lit(VISIBILITY_BOOST["public"])
    for name, factor in VISIBILITY_BOOST.items():
        out = F.when(low == name, F.lit(factor)).otherwise(out)
    return out


def namespace_boost(unit: Column, ranking: Ranking) -> Column:
    return F.when(namespace(unit).isin(list(ranking.namespaces)), F.lit(ranking.boost)).otherwise(F.lit(1.0))


def candidates(chunks: DataFrame, queries: DataFrame, *, k: int | Column = 10, scoped: bool = True, dim: int = 64, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, id, base_distance, base_rank``: the ``k`` chunks of the least cosine distance for each query.

    ``queries`` has ``query_id, embedding`` and, if ``scoped``, ``library`` and, if it likes, ``version``: then only
    chunks of that library count, and of that version where it isn't null.  ``k`` may be an expression on ``queries``; a null or negative one gives
    no hits.  Distances are rounded to 6 decimals; ties go to the smaller id.  Unusable vectors and queries take no part.

    Plan: if there are at most ``block`` queries they are sent to all tasks, which read the chunks in place.  More queries
    than that are cut into blocks of a library, chunks into slices of it; each block meets each slice in one task of bounded
    size, so that a library with a third of all rows is spread over many.  Either way a task multiplies its
    chunks with its queries and keeps the best of each query, and these are merged by query."""
    near = _nearest(chunks, queries, k, scoped, dim, block)
    return near.select("query_id", "id", "base_distance", "base_rank")


def _nearest(chunks: DataFrame, queries: DataFrame, k: int | Column, scoped: bool, dim: int, block: int) -> DataFrame:
    """``candidates`` with the ``k`` of each query."""
    version = F.col("version") if scoped and "version" in queries.columns else F.lit(None).cast("string")
    wanted = (F.lit(k) if isinstance(k, int) else k).cast("int")
    q = queries.select("query_id", F.col("library") if scoped else F.lit("").alias("library"), version.alias("version"), "embedding", wanted.alias("k")).where(usable(F.col("embedding"), dim) & (F.col("k") > 0) & F.col("library").isNotNull())
    c = chunks.select("id", F.col("library") if scoped else F.lit("").alias("library"), F.col("version") if scoped and "version" in chunks.columns else F.lit(None).cast("string").alias("version"), "embedding").where(usable(F.col("embedding"), dim) & F.col("library").isNotNull())
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, k int, id bigint, base_distance double"
    if q.limit(block + 1).count() <= block:
        shared = chunks.sparkSession.sparkContext.broadcast(q.toArrow())
        found = c.mapInArrow(lambda batches: _best(shared.value, batches, dim), schema)
    else:
        rows = max(1024, SLICE_BYTES // (4 * dim))
        parts = lambda df, size, name: df.groupBy("library").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
        sizes = parts(q, block, "blocks").join(parts(c, rows, "slices"), "library")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = q.join(sizes, "library").select("query_id", "library", "version", "embedding", "k", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("b"), each("slices").alias("s"))
        # queries may be made of the chunks, so that the chunks' columns need names of their own
        c = c.join(sizes, "library").select(*(F.col(x).alias("_" + x) for x in ("id", "library", "version", "embedding")), F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("_s"), each("blocks").alias("_b"))

        def meet(own: pa.Table, rows: pa.Table) -> pa.Table:
            out = list(_best(own.select(["query_id", "library", "version", "embedding", "k"]), rows.select(["_id", "_library", "_version", "_embedding"]).to_batches(), dim))
            # ids that are structs come without nulls, which Spark takes for another type than that of the schema
            return pa.Table.from_batches(out).cast(empty.schema) if out else empty

        empty = pa.Table.from_batches([], to_arrow_schema(_parse_datatype_string(schema)))
        found = q.groupBy("library", "b", "s").cogroup(c.groupBy("_library", "_b", "_s")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy("base_distance", "id")
    return found.withColumn("base_rank", F.row_number().over(order).cast("bigint")).where(F.col("base_rank") <= F.col("k"))


def _unit_rows(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _trimmed(row: np.ndarray, d: np.ndarray, i: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row (of queries) the ``k`` of it that are nearest."""
    order = np.lexsort((i, d, row))
    row, d, i = row[order], d[order], i[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k[row]
    return row[keep], d[keep], i[keep]


def _best(own: pa.Table, batches: Iterable[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """The nearest of the chunks in ``batches`` to each query of ``own`` that they are in the scope of."""
    if not len(own):
        return
    queries, k = _unit_rows(own.column("embedding"), dim), own.column("k").to_numpy()
    scopes: dict = {}
    for n, scope in enumerate(zip(own.column("library").to_pylist(), own.column("version").to_pylist())):
        scopes.setdefault(scope[0], {}).setdefault(scope[1], []).append(n)
    best: dict = {}
    for batch in batches:
        if not len(batch):
            continue
        libraries, versions = (np.array(batch.column(n).to_pylist(), object) for n in (1, 2))
        here = set(libraries.tolist()) & set(scopes)
        if not here:
            continue
        ids, vectors = batch.column(0).to_numpy(), _unit_rows(batch.column(3), dim)
        for library in here:
            mine = libraries == library
            for version, rows in scopes[library].items():
                at = np.flatnonzero(mine if version is None else mine & (versions == version))
                for part in range(0, len(at), STEP):
                    some = at[part : part + STEP]
                    for first in range(0, len(rows), STEP):
                        q = np.array(rows[first : first + STEP])
                        d = np.round(1 - queries[q] @ vectors[some].T, 6) + 0.0
                        most = int(k[q].max())
                        row, col = np.nonzero(d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most] if most < len(some) else np.isfinite(d))
                        before = best.get((library, version, first), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
                        best[library, version, first] = _trimmed(*(np.concatenate(x) for x in zip(before, (q[row], d[row, col], ids[some[col]]))), k)
    names = own.column("query_id").combine_chunks()
    for row, d, i in best.values():
        yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(k[row], pa.int32()), pa.array(i), pa.array(d)], ["query_id", "k", "id", "base_distance"])


def rerank(chunks: DataFrame, queries: DataFrame, *, k: int | Column = 10, ranking: Ranking = Ranking(), scoped: bool = True, dim: int = 64) -> DataFrame:
    """``query_id, rank, id, base_distance, distance``: candidates, ``oversample`` times as many as asked for if any
    namespace comes first, in the order of the distance times the boosts; ties keep the candidates' order.  ``k`` as in ``candidates``."""
    times = ranking.oversample if ranking.namespaces else 1
    near = _nearest(chunks, queries, k * times, scoped, dim, QUERY_BLOCK)
    meta = chunks.select("id", "unit_name", "visibility")
    boosted = near.join(meta, "id").withColumn("distance", F.round(F.col("base_distance") * namespace_boost(F.col("unit_name"), ranking) * visibility_boost(F.col("visibility")), 9))
    order = Window.partitionBy("query_id").orderBy("distance", "base_rank")
    return boosted.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") * times <= F.col("k")).select("query_id", "rank", "id", "base_distance", "distance")


def fanout(chunks: DataFrame, queries: DataFrame, *, k: int | Column = 5, ranking: Ranking = Ranking(), dim: int = 64) -> DataFrame:
    """``query_id, pos, rank, id, base_distance, distance``: the hits of each query in each of its scopes (``query_id, pos, library,
    version, embedding``), ``k`` of each scope, in the order of ``pos`` and ``rank``, without ranking over scopes; scopes without hits have no rows."""
    hits = rerank(chunks, queries.withColumn("query_id", F.struct("query_id", "pos")), k=k, ranking=ranking, dim=dim)
    return hits.select("query_id.query_id", "query_id.pos", "rank", "id", "base_distance", "distance")


def _fits(of: str) -> Column:
    """Whether a query's own scope, where it has one, is that of a hit."""
    return F.col(of).isNull() | (F.col(of) == F.col(f"_{of}"))


def identified(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``query_id, id, chunk_type``: all chunks with exactly the identifier ``text``, of the given ``library`` and ``version`` where they aren't null.

    Names with a library meet chunks by name and library, so that a name that all libraries have is no hot key."""
    hits = chunks.select("id", "chunk_type", F.col("identifier").alias("text"), F.col("library").alias("_library"), F.col("version").alias("_version"))
    here = names.where("library is not null").join(hits.withColumn("library", F.col("_library")), ["text", "library"])
    anywhere = names.where("library is null").drop("library").join(hits, "text")
    out = lambda df: df.where(_fits("version")).select("query_id", "id", "chunk_type")
    return out(here).unionAll(out(anywhere))


def lookup(chunks: DataFrame, names: DataFrame, *, chunk_type: str = "type") -> DataFrame:
    """``query_id, found, id, size``: for each named class (``query_id, text, library, version``) the longest chunk with
    exactly that identifier, of the given library and version where they aren't null; ties go to the smaller id.
    Names without a hit come out with ``found`` false.

    Chunks are reduced to the longest one of each identifier, library and version before they meet any name."""
    longest = F.max(F.struct(F.coalesce(F.length("content"), F.lit(-1)).cast("bigint").alias("size"), (-F.col("id")).alias("id"))).alias("m")
    hits = chunks.where((F.col("chunk_type") == chunk_type) & F.col("identifier").isNotNull()).groupBy(F.col("identifier").alias("text"), F.col("library").alias("_library"), F.col("version").alias("_version")).agg(longest)
    wanted = names.select("query_id", "text", "library", "version")
    met = wanted.join(hits, "text").where(_fits("library") & _fits("version"))
    best = met.groupBy("query_id").agg(F.max("m").alias("m")).select("query_id", (-F.col("m.id")).alias("id"), F.when(F.col("m.size") >= 0, F.col("m.size")).alias("size"))
    return wanted.select("query_id").join(best, "query_id", "left").select("query_id", F.col("id").isNotNull().alias("found"), "id", "size")


def _decimals(value: Column, n: int) -> Column:
    return F.format_string(f"%.{n}f", F.round(value, n))


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("string")


def not_found(library: Column, version: Column) -> Column:
    return F.concat(F.lit("No relevant "), F.coalesce(library, F.lit("")), F.lit(" source found for that query"), F.coalesce(F.concat(F.lit(" (version "), version, F.lit(").")), F.lit(".")))


def rendered(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, report`` of each query (``query_id, text, library, version``): a heading with the number of hits, then a block
    for each hit in the order of rank with its place, visibility, distance and whole content; a message for queries without hits."""
    meta = chunks.select("id", "unit_name", "identifier", "chunk_type", "section", F.coalesce("visibility", F.lit("public")).alias("visibility"), F.col("library").alias("_library"), F.col("version").alias("_version"), "start_line", "content")
    text = [F.lit("--- ["), F.col("rank").cast("string"), F.lit("] "), _or_empty("unit_name"), F.lit("."), _or_empty("identifier"), F.lit(" ("), _or_empty("chunk_type"), F.lit(", "), _or_empty("section"), F.lit(", visibility "), F.col("visibility"), F.lit(", "), _or_empty("_library"), F.lit(" "), _or_empty("_version"), F.lit(", line "), _or_empty("start_line"), F.lit(") [distance: "), _decimals(F.col("distance"), 4), F.lit("] ---\n"), _or_empty("content"), F.lit("\n")]
    blocks = hits.join(meta, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(*text).alias("b")))).alias("_b"))
    met = queries.select("query_id", "text", "library", "version").join(blocks, "query_id", "left")
    head = F.concat(F.lit("Found "), F.size("_b").cast("string"), F.lit(" relevant "), _or_empty("library"), F.lit(' chunks for: "'), _or_empty("text"), F.lit('"\n\n'))
    return met.select("query_id", F.when(F.col("_b").isNull(), not_found(F.col("library"), F.col("version"))).otherwise(F.concat(head, F.array_join(F.transform("_b", lambda x: x["b"]), "\n"))).alias("report"))


def rendered_lookup(found: DataFrame, chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``query_id, report`` of the names looked up: the declaration found, under the name that was asked for, or the message that there is none."""
    meta = chunks.select("id", "unit_name", F.coalesce("visibility", F.lit("public")).alias("visibility"), F.col("library").alias("_library"), F.col("version").alias("_version"), "content")
    met = names.select("query_id", "text", "library", "version").join(found.where("found").select("query_id", "id").join(meta, "id"), "query_id", "left")
    text = F.concat(F.lit("--- "), _or_empty("unit_name"), F.lit("."), _or_empty("text"), F.lit(" ("), _or_empty("_library"), F.lit(" "), _or_empty("_version"), F.lit(", type declaration, visibility "), F.col("visibility"), F.lit(") ---\n"), _or_empty("content"), F.lit("\n"))
    return met.select("query_id", F.when(F.col("id").isNull(), not_found(F.col("library"), F.col("version"))).otherwise(text).alias("report"))


def compared(hits: DataFrame, chunks: DataFrame, *, size: int = 120) -> DataFrame:
    """``query_id, version, markdown``: the hits of a query in one of the compared versions as a list, texts cut to ``size``."""
    meta = chunks.select("id", "version", "unit_name", "section", "identifier", "start_line", truncated(F.coalesce("content", F.lit("")), size).alias("head"))
    text = [F.lit("**Rank "), F.col("rank").cast("string"), F.lit("** (dist="), _decimals(F.col("distance"), 4), F.lit(")\n- Unit: `"), _or_empty("unit_name"), F.lit("`\n- Section: "), _or_empty("section"), F.lit("\n- Identifier: `"), _or_empty("identifier"), F.lit("`\n- Line: "), _or_empty("start_line"), F.lit("\n- Content: "), F.col("head"), F.lit("\n")]
    each = hits.join(meta, "id").groupBy("query_id", "version").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(*text).alias("b")))).alias("_b"))
    return each.select("query_id", "version", F.concat(F.lit("### "), F.col("version"), F.lit(" Results:\n"), F.array_join(F.transform("_b", lambda x: x["b"]), "\n")).alias("markdown"))
