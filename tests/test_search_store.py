import numpy as np
import pytest
from pyspark.sql import functions as F

from unitquarry.engine import Engine
from unitquarry.functions.embedding import HashingEmbedder, TransientError, embedded, transient, with_retry
from unitquarry.operators import scopes, search, store
from unitquarry.plans import search_queries
from unitquarry.session import stored
from unitquarry.sources.tables import spread
from unitquarry.streaming.ingest import ingest_available

SMOKE = "/root/testdata/sf0.001"
CHUNKS = "id long, library string, version string, unit_name string, chunk_type string, identifier string, content string, visibility string, embedding array<float>"


def vec(*head):
    return [float(x) for x in head] + [0.0] * (64 - len(head))


def chunk(i, e, library="l", unit="Demo.U", visibility=None, ident="TX", content="text", version="1"):
    return i, library, version, unit, "type", ident, content, visibility, e


def test_visibility_moves_close_hits(spark):
    near = {"private": 0.99, "protected": 0.98995, "public": 0.9899, "published": 0.9898}
    rows = [chunk(i, vec(s, (1 - s * s) ** 0.5), visibility=v) for i, (v, s) in enumerate(near.items())]
    c = spark.createDataFrame(rows, CHUNKS)
    q = spark.createDataFrame([(1, "l", vec(1.0))], "query_id long, library string, embedding array<float>")
    out = search.rerank(c, q, k=4, ranking=search.Ranking(namespaces=())).orderBy("rank").collect()
    assert [r.id for r in out] == [3, 2, 1, 0]
    assert [round(r.distance, 6) for r in out] == [0.009588, 0.009797, 0.010251, 0.0105]


def test_namespaces_pull_candidates_from_beyond_k(spark):
    rows = [chunk(i, vec(1.0, 0.30 + 0.001 * i)) for i in range(6)] + [chunk(9, vec(1.0, 0.3035), unit="System.X")]
    c = spark.createDataFrame(rows, CHUNKS)
    q = spark.createDataFrame([(1, "l", vec(1.0))], "query_id long, library string, embedding array<float>")
    assert [r.id for r in search.rerank(c, q, k=1).collect()] == [9]
    assert [r.id for r in search.rerank(c, q, k=1, ranking=search.Ranking(namespaces=())).collect()] == [0]


def test_candidates_in_blocks_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [chunk(i, rng.normal(size=64).tolist(), library="ab"[i % 2]) for i in range(60)] + [chunk(100 + i, vec(1.0)) for i in range(4)]
    rows += [chunk(200, None), chunk(201, []), chunk(202, vec(0.0)), chunk(203, vec(1.0), library=None)]
    c = spark.createDataFrame(rows, CHUNKS)
    q = c.selectExpr("id as query_id", "library", "embedding")
    want = sorted((r.query_id, r.id, r.base_rank) for r in search.candidates(c, q, k=3).collect())
    assert {i for i, *_ in want} == {*range(60), *range(100, 104)}
    assert [(i, r) for n, i, r in want if n == 103] == [(100, 1), (101, 2), (102, 3)]
    own_k = q.withColumn("version", F.when(F.col("query_id") % 3 == 0, "1"))
    for scoped in (True, False):
        k = F.when(F.col("query_id") < 100, F.col("query_id") % 4)
        few, many = (sorted((r.query_id, r.id, r.base_rank) for r in search.candidates(c, own_k, k=k, scoped=scoped, block=b).collect()) for b in (4096, 7))
        assert few == many and {n: sum(x[0] == n for x in few) for n in range(60)} == {n: n % 4 for n in range(60)} and not any(x[0] >= 100 for x in few)
    assert sorted((r.query_id, r.id, r.base_rank) for r in search.candidates(c, q, k=3, block=7).collect()) == want
    elsewhere = q.withColumn("version", F.lit("2"))
    assert search.candidates(c, elsewhere, k=3).count() == 0 and search.candidates(c, elsewhere, k=3, block=7).count() == 0
    assert search.candidates(c, q.limit(0), k=3).count() == 0 and search.candidates(c.limit(0), q, k=3).count() == 0


@pytest.mark.parametrize("part", ["cast(1 as int) as turn", "cast(1 as bigint) as pos"])
def test_queries_with_struct_ids_in_blocks(spark, part):
    rng = np.random.default_rng(2)
    c = spark.createDataFrame([chunk(i, rng.normal(size=64).tolist(), library="ab"[i % 2]) for i in range(60)], CHUNKS)
    q = c.selectExpr("id", part, "library", "embedding").select(F.struct("id", part.split()[-1]).alias("query_id"), "library", "embedding")
    few, many = (sorted((tuple(r.query_id), r.id, r.base_distance, r.base_rank) for r in search.candidates(c, q, k=3, block=b).collect()) for b in (4096, 7))
    assert few == many and len(few) == 180


@pytest.mark.parametrize("name", ["compare_markdown", "fanout_search"])
def test_compared_and_fanned_out_queries_beyond_one_block(spark, monkeypatch, name):
    run = lambda: sorted(map(repr, search_queries.QUERIES[name](spark, SMOKE).collect()))
    few = run()
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)
    assert few and run() == few


def test_lookup_prefers_the_longest_and_reports_misses(spark):
    c = spark.createDataFrame([chunk(1, None, content="short"), chunk(2, None, content="much longer"), chunk(3, None, content="much longer"), chunk(4, None, ident="tx")], CHUNKS)
    names = spark.createDataFrame([("a", "TX", None, None), ("b", "TX", "other", None), ("c", None, None, None)], "query_id string, text string, library string, version string")
    assert sorted((r.query_id, r.found, r.id) for r in search.lookup(c, names).collect()) == [("a", True, 2), ("b", False, None), ("c", False, None)]


def test_fan_out_in_order_and_reports(spark):
    rows = [chunk(i, vec(1.0, 0.1 * i), version=v, content=f"c{i}") for i, v in enumerate(["1", "1", "2", "2", "3"])]
    c = spark.createDataFrame([(*r, "interface", 7) for r in rows], CHUNKS + ", section string, start_line int")
    q = spark.createDataFrame([("a", n, "l", v, vec(1.0)) for n, v in ((1, "2"), (2, "9"), (3, "1"))], "query_id string, pos long, library string, version string, embedding array<float>")
    assert sorted((r.pos, r["rank"], r.id) for r in search.fanout(c, q, k=5).collect()) == [(1, 1, 2), (1, 2, 3), (3, 1, 0), (3, 2, 1)]
    asked = spark.createDataFrame([("a", "x y", "l", "3"), ("b", None, "l", "9"), ("c", None, None, None)], "query_id string, text string, library string, version string")
    hits = search.rerank(c, asked.where("query_id = 'a'").withColumn("embedding", F.array(*map(F.lit, vec(1.0)))), k=2)
    got = {r.query_id: r.report for r in search.rendered(hits, c, asked).collect()}
    assert got["a"] == 'Found 1 relevant l chunks for: "x y"\n\n--- [1] Demo.U.TX (type, interface, visibility public, l 3, line 7) [distance: 0.0694] ---\nc4\n'
    assert got["b"] == "No relevant l source found for that query (version 9)." and got["c"] == "No relevant  source found for that query."


def test_queries_without_a_library_are_for_every_library(spark):
    delivered = spark.range(12_000).selectExpr("concat('L', id) as library", "'1' as version", "timestamp'2020-01-01' as released_at")
    q = spark.createDataFrame([("a", None, None), ("b", " ", "7"), ("c", "l5", None)], "query_id string, library string, version string")
    assert {r.query_id: r["count"] for r in scopes.expanded(q, delivered).groupBy("query_id").count().collect()} == {"a": 12_000, "b": 12_000, "c": 1}


def test_long_texts_are_embedded_in_pieces(spark):
    class Lengths:
        most_chars = 4

        def embed(self, texts):
            assert max(map(len, texts)) <= 4
            return [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "ab")], "id long, content string")
    assert {r.id: r.embedding for r in embedded(docs, Lengths()).collect()} == {1: [pytest.approx(3.6), 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0], 4: [2.0, 1.0]}


def test_store_round_trip_evolution_and_deletion(spark, tmp_path):
    path = str(tmp_path / "store")
    c = spark.createDataFrame([chunk(1, vec(1.0), version="12.0"), chunk(2, None, version="12.10")], CHUNKS)
    store.append(c.drop("visibility"), path)
    store.append(c.selectExpr("id + 10 as id", "library", "version", "visibility as VISIBILITY", "'x' as extra"), path)
    back = store.read(spark, path)
    assert sorted((r.id, r.version, r.visibility) for r in back.collect()) == [(1, "12.0", None), (2, "12.10", None), (11, "12.0", None), (12, "12.10", None)]
    scope = lambda v: spark.createDataFrame([("l", v)], "library string, version string")
    assert store.delete_scope(back, scope("12.0")).count() == 2 and store.delete_scope(back, scope(None)).count() == 0
    store.compact(spark, path, str(tmp_path / "b"))
    assert store.read(spark, str(tmp_path / "b")).count() == 4
    plan = back.where("library = 'l' and version = '12.0'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(library" in plan


UNIT = "unit A;\n\ninterface\n\ntype\n  TAlpha = class\n    FSize: Integer;\n  end;\n\nprocedure Run;\n\nimplementation\n\nprocedure Run;\nbegin\nend;\n\nend.\n"


def test_engine_indexes_resumes_and_streams(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "A.PAS").write_text(UNIT)
    e = Engine(spark, str(tmp_path / "s"), HashingEmbedder())
    e.index(str(src), "lib", "1.0")
    assert e.chunks().count() == 4
    e.index(str(src), "lib", "1.0")
    assert e.chunks().count() == 4
    names = spark.createDataFrame([("1", "TAlpha", "lib", None), ("2", "TBeta", None, None)], "query_id string, text string, library string, version string")
    got = sorted((r.query_id, r.match) for r in e.lookup(names).collect())
    assert got == [("1", "exact")] + [("2", "semantic")] * 3
    asked = spark.createDataFrame([("1", "class TAlpha", "lib", "1.0", 2), ("2", "class TAlpha", "lib", "9", 2), ("3", "run", None, None, None)], "query_id string, text string, library string, version string, k int")
    assert {r.query_id: r["count"] for r in e.search(asked).groupBy("query_id").count().collect()} == {"1": 2, "3": 4}
    assert e.bench("lib", times=1)["hits"] == 4
    with pytest.raises(ValueError, match="32"):
        Engine(spark, str(tmp_path / "s"), HashingEmbedder(32)).search(asked)
    assert e.reset("lib", None, str(tmp_path / "t")) == 4
    for n in (4, 4):
        ingest_available(spark, str(src), "lib", "2.0", str(tmp_path / "u"), str(tmp_path / "cp"), HashingEmbedder()).awaitTermination(60)
        assert store.read(spark, str(tmp_path / "u")).count() == n


def test_tables_in_the_shared_folder_and_spread_scans(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "cast(null as string) as s", "array(id) as a")
    back = stored(df)
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect()) and stored(df.limit(0)).count() == 0
    df.coalesce(1).write.parquet(str(tmp_path / "t"))
    wide = spread(spark.read.parquet(str(tmp_path / "t")))
    cores = spark.sparkContext.defaultParallelism
    assert wide.rdd.getNumPartitions() == cores and wide.count() == 5 and spread(wide) is wide
    plan = wide.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_retry():
    calls, waits = [], []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise TransientError
        return ["ok"]

    assert with_retry(flaky, ["a"], sleep=waits.append) == ["ok"] and waits == [1.0, 2.0]
    assert transient(TimeoutError()) and transient(ConnectionResetError()) and not transient(ValueError())
    with pytest.raises(ValueError):
        with_retry(lambda t: [][1:] if t else float("x"), [], sleep=waits.append)
    with pytest.raises(TransientError):
        with_retry(lambda t: (_ for _ in ()).throw(TransientError()), ["a"], sleep=waits.append)
