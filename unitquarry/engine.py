"""The engine as one object: a store, and what can be asked of it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitquarry.functions.embedding import Embedder, embedded
from unitquarry.operators import chunker, scopes, search, store
from unitquarry.sources.scan import scan_tree
from unitquarry.streaming.ingest import keyed


class Engine:
    def __init__(self, spark: SparkSession, path: str, embedder: Embedder) -> None:
        self.spark, self.path, self.embedder = spark, path, embedder

    def _exists(self) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf).exists(p)

    def chunks(self) -> DataFrame:
        return store.read(self.spark, self.path) if self._exists() else self.spark.createDataFrame([], store.SCHEMA)

    def index(self, root: str, library: str, version: str, *, most: int | None = None) -> None:
        """Add what the store lacks of a source tree; a run that was broken off goes on where it stopped."""
        if not (library and version):
            raise ValueError("library and version are required")
        have = store.counts(self.chunks().where((F.col("library") == library) & (F.col("version") == version)))
        todo = chunker.to_index(chunker.ordinals(chunker.chunk_files(scan_tree(self.spark, root, library, version))), have, most=most)
        store.append(embedded(keyed(todo), self.embedder), self.path)

    def _dim(self) -> int:
        """The length of the embedder's vectors, which must be that of the store's."""
        dim = len(self.embedder.embed(["x"])[0])
        first = self.chunks().where("size(embedding) > 0").select(F.size("embedding").alias("n")).first()
        if first is not None and first.n != dim:
            raise ValueError(f"the store holds vectors of {first.n} numbers, the embedder gives {dim}")
        return dim

    def search(self, queries: DataFrame, *, k: int = 5, ranking: search.Ranking = search.Ranking()) -> DataFrame:
        """Hits of ``query_id, text, library`` and, if there are such columns, ``version`` and ``k``.  Without a library all
        chunks count, whatever the version; ``k`` is clamped to 1..10."""
        have = [c for c in ("version", "k") if c in queries.columns]
        asked = embedded(queries.select("query_id", "text", "library", *have), self.embedder, text="text")
        most, c, dim = scopes.clamped(F.col("k") if "k" in have else F.lit(k)), self.chunks(), self._dim()
        own, every = asked.where("library is not null"), asked.where("library is null")
        return search.rerank(c, own, k=most, ranking=ranking, dim=dim).unionAll(search.rerank(c, every, k=most, ranking=ranking, scoped=False, dim=dim))

    def fanout(self, queries: DataFrame, releases: DataFrame, *, k: int = 5) -> DataFrame:
        """Hits of ``query_id, text, library, version`` in each scope that a query is for, in the order of ``pos`` and ``rank``."""
        asked = embedded(queries.select("query_id", "text"), self.embedder, text="text")
        return search.fanout(self.chunks(), self.expand(queries, releases).join(asked, "query_id"), k=scopes.clamped(F.lit(k)), dim=self._dim())

    def report(self, queries: DataFrame, *, k: int = 5) -> DataFrame:
        """``query_id, report`` of ``query_id, text, library, version``."""
        return search.rendered(self.search(queries, k=k), self.chunks(), queries)

    def lookup(self, names: DataFrame) -> DataFrame:
        """Classes by name; those without a hit are searched for by meaning: ``query_id, match, id``."""
        exact = search.lookup(self.chunks(), names)
        rest = exact.where(~F.col("found")).select("query_id").join(names, "query_id").select("query_id", F.concat(F.lit("class declaration "), "text").alias("text"), "library", "version")
        near = self.search(rest, k=3).select("query_id", F.lit("semantic").alias("match"), "id")
        return exact.where("found").select("query_id", F.lit("exact").alias("match"), "id").unionAll(near)

    def bench(self, library: str, version: str | None = None, *, times: int = 20, k: int = 10) -> dict[str, float]:
        """Milliseconds of a search with a stored vector: the first, and the average of ``times`` more; how many hits came."""
        rows = self.chunks().where((F.col("library") == library) & (F.lit(version).isNull() | (F.col("version") == version)))
        q = store.first_embedding(rows).orderBy("id").limit(1).select(F.lit(1).alias("query_id"), "library", F.lit(version).cast("string").alias("version"), "embedding")
        took, hits, dim = [], [], self._dim()
        for _ in range(times + 1):
            began = time.perf_counter()
            hits = search.rerank(self.chunks(), q, k=k, dim=dim).collect()
            took.append((time.perf_counter() - began) * 1000)
        return {"first_ms": took[0], "average_ms": sum(took[1:]) / max(1, times), "hits": len(hits)}

    def compare(self, texts: DataFrame, library: str, older: str, newer: str, *, k: int = 5) -> DataFrame:
        """``query_id, version, markdown``: the hits of ``query_id, text`` in two versions of a library, side by side."""
        two = self.spark.createDataFrame([(library, older), (library, newer)], "library string, version string")
        q = embedded(texts.select("query_id", "text"), self.embedder, text="text").join(two, F.lit(True)).withColumn("query_id", F.struct("query_id", "version"))
        out = search.compared(search.rerank(self.chunks(), q, k=k, dim=self._dim()), self.chunks())
        return out.select("query_id.query_id", "version", "markdown")

    def versions(self) -> DataFrame:
        return store.counts(self.chunks())

    def reset(self, library: str, version: str | None, to: str) -> int:
        """Write the store without a scope to ``to``, use it from now on, and give the number of chunks that went."""
        rows = self.chunks()
        scope = self.spark.createDataFrame([(library, version)], "library string, version string")
        left = store.delete_scope(rows, scope)
        gone = rows.count() - left.count()
        store.append(left, to)
        self.path = to
        return gone

    def compact(self, to: str) -> None:
        store.compact(self.spark, self.path, to)
        self.path = to

    def expand(self, queries: DataFrame, releases: DataFrame) -> DataFrame:
        return scopes.expanded(queries, self.versions().join(releases, ["library", "version"]))
