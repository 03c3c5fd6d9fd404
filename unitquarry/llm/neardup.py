"""Near-duplicate texts: all pairs whose word runs overlap enough, by a size-aware heavy-light join.

A text is the set of its distinct runs of successive words.  Equal sets are one class.  Of a class, the rarest runs
form a prefix that any similar class must share.  Small sets are matched by subsets of their prefixes: pairs of runs, and
where a run is so rare that its list is short, that run alone.  Large sets, of which the pairs would be too many, scan the
inverted lists of single runs, long lists in parts.  Where small ends is chosen by the cost of both ways, counted over the whole table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitquarry.session import stored

#: Successive words of a run, similarity, least words of a text that takes part.
RUN, SIMILARITY, WORDS = 3, 0.7, 30
#: A list up to this length is short: a small set sends its run alone.  Sets of a long list that are looked at in one task by one large set, about.
SHORT, PART = 32, 4096
#: Counters of the order by rarity (a fixed table of 2 MB) and sizes that the cost model tells apart.
COUNTERS, SIZES = 1 << 18, 4096

_WORD = re.compile(rb"[a-z0-9_]+")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def run_sets(run: int, least: int):
    """A function from texts to (row, sorted distinct run hashes) of the texts with enough words."""
    odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)

    def sets(texts: list[str | None], known: dict) -> Iterator[tuple[int, np.ndarray]]:
        for row, text in enumerate(texts):
            words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else ()
            if len(words) < max(least, run):
                continue
            w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            h = np.zeros(len(w) - run + 1, np.uint64)
            for i in range(run):
                h = (h ^ w[i : len(w) - run + 1 + i]) * odd[i % len(odd)]
                h ^= h >> np.uint64(29)
            yield row, np.unique(h.view(np.int64))

    return sets


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), kind))


def classes_of(rows: DataFrame, *, key: str, text: str, run: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(class, runs) of the distinct sets, and (class, id) of the rows.  A class is named by its smallest id."""
    sets = run_sets(run, least)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                kept, values = [], []
                for row, v in sets(batch.column(1).to_pylist(), known):
                    kept.append(row)
                    values.append(v)
                digest = [xxhash.xxh3_128_digest(v.tobytes()) for v in values]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(digest, pa.binary()), _lists(values, pa.int64())], ["id", "h", "runs"])

    usable = rows.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") >= 2 * least - 1))
    read_sets = usable.mapInArrow(read, "id bigint, h binary, runs array<bigint>")
    # Reading the words twice costs less than keeping the sets of all copies.
    kinds = stored(read_sets.groupBy("h").agg(F.min("id").alias("class"), F.any_value("runs").alias("runs")))
    members = read_sets.select("id", "h").distinct().join(kinds.select("h", "class"), "h").select("class", "id")
    return kinds.select("class", "runs"), stored(members)


def _prefix(n: np.ndarray | int, similarity: float):
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


#: Pairs that are looked at in the time that one row takes to be sent and sorted.
PAIRS_PER_ROW = 16


def choose_boundary(by_size: pd.DataFrame) -> int:
    """The largest size of a small set: the boundary of the least cost, in rows sent; the larger one where costs are equal,
    as small sets meet no long list; 0 if scanning is cheapest for all.

    ``by_size``: size; what these sets send as large ones and the links they look at then (the lengths of their lists,
    summed); what they send as small ones (runs alone and pairs of runs) and the links of their short lists."""
    if by_size.empty:
        return 0
    t = by_size.sort_values("size")
    large, small = ((t[f"{c}_rows"] + t[f"{c}_links"] / PAIRS_PER_ROW).to_numpy(np.float64) for c in ("large", "small"))
    cost = np.concatenate([[0.0], np.cumsum(small)]) + np.concatenate([np.cumsum(large[::-1])[::-1], [0.0]])
    best = len(cost) - 1 - int(cost[::-1].argmin())
    return 0 if best == 0 else int(t["size"].iloc[best - 1])


def similar_classes(sets: DataFrame, *, similarity: float = SIMILARITY, boundary: int | None = None, short: int = SHORT, part: int = PART) -> DataFrame:
    """``class_a, class_b``: all pairs of classes whose sets' Jaccard similarity is at least ``similarity``.

    ``boundary``: the largest size of a small set; chosen by cost where it isn't given.

    Two similar sets share a run of their prefixes, and two of the prefixes with one run more.  The first run that they share is
    sent alone by both if its list is short, else with each run behind it."""
    spark = sets.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["counter", "n"])

    def table(of) -> np.ndarray:
        got = sets.select("runs").mapInArrow(of, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
        out = np.zeros(COUNTERS, np.int64)
        out[got["counter"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
        return out

    shared = spark.sparkContext.broadcast(table(count))

    def prefixes(column: pa.Array, more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sizes of the sets of a batch; owner, place and run of their prefixes, with ``more`` runs behind them).

        Runs are in the order of their rarity, each run's counter standing for it; any fixed order is right, the rare ones first are quick."""
        flat, offs = column.flatten().to_numpy(), column.offsets.to_numpy()
        size = np.diff(offs)
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat, shared.value[flat & (COUNTERS - 1)], owner))
        at = np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], size)
        keep = at < np.repeat(_prefix(size, similarity) + more, size)
        return size, owner[keep], at[keep], flat[order][keep]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            seen += np.bincount(prefixes(batch.column(0))[3] & (COUNTERS - 1), minlength=COUNTERS)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["counter", "n"])

    posted = spark.sparkContext.broadcast(table(post))
    least = next(n for n in range(1, 1000) if ceil(similarity * n - 1e-9) >= 2)  # smaller sets can't share two runs
    parts = ("large_rows", "large_links", "small_rows", "small_links")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(parts), SIZES + 1))
        for batch in batches:
            size, owner, at, run = prefixes(batch.column(0))
            links = posted.value[run & (COUNTERS - 1)]
            behind = (_prefix(size, similarity)[owner] - at).astype(np.float64)
            for out, what in zip(sums, (np.ones(len(run)), links, np.where(links > short, behind, 1), np.where(links > short, 0, links))):
                out += np.bincount(np.minimum(size[owner], SIZES), what, SIZES + 1)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(x[used]) for x in sums)], ["size", *parts])

    if boundary is None:
        weighed = sets.select("runs").mapInArrow(weigh, "size bigint, " + ", ".join(f"{c} double" for c in parts))
        by_size = weighed.groupBy("size").agg(*(F.sum(c).alias(c) for c in parts)).toPandas()
        boundary = choose_boundary(by_size)
        boundary = SIZES if len(by_size) and boundary == by_size["size"].max() else boundary
    last = boundary if boundary < SIZES else 1 << 30
    some_large = last < 1 << 30

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of the sets: 0 a run alone of a small set, 1 a run of a large set, 2 a run of a small set that only large sets look for, 3 a pair of runs of a small set."""
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.slice(start, 500)
                if not len(batch):
                    continue
                name, (size, owner, at, run) = batch.column(0).to_numpy(), prefixes(batch.column(1), 1)
                own = at < _prefix(size, similarity)[owner]
                small = ((size >= least) & (size <= last))[owner]
                links = posted.value[run & (COUNTERS - 1)]
                long = links > short
                kind = np.where(~small, 1, np.where(long, 2, 0))
                one = np.flatnonzero(own & ((kind != 2) | some_large))
                # each long run of a small set with each run behind it
                first = np.flatnonzero(own & small & long)
                ends = np.searchsorted(owner, owner[first], "right")
                times = ends - first - 1
                a = np.repeat(first, times)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
                both = (run[a].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ run[b].view(np.uint64)
                both = (both ^ (both >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
                row = np.concatenate([one, a])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([run[one], both.view(np.int64)])),
                        pa.array(name[owner[row]]),
                        pa.array(size[owner[row]].astype(np.int32)),
                        pa.array(at[row].astype(np.int32)),
                        pa.array(np.concatenate([kind[one], np.full(len(a), 3)]).astype(np.int32)),
                        pa.array((1 + links[row] // part).astype(np.int32)),
                    ],
                    ["k", "class", "size", "pos", "kind", "parts"],
                )

    def meet(left: DataFrame, right: DataFrame, keys: list[str], which) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        enough = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("a.size") + F.col("b.size")) - F.lit(1e-6))
        reach = F.least("a.pos", "b.pos") + F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
        near = (F.least("a.size", "b.size") >= F.lit(similarity) * F.greatest("a.size", "b.size") - F.lit(1e-6)) & (reach >= enough)
        for k in keys:
            near = near & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        return a.join(b, which & near).select(F.least("a.class", "b.class").alias("class_a"), F.greatest("a.class", "b.class").alias("class_b"))

    sent = sets.select("class", "runs").mapInArrow(emit, "k bigint, class bigint, size int, pos int, kind int, parts int")
    # Both sides are the same, so that they are made and sent once.
    of_small = sent.where("kind in (0, 3)").select("k", "class", "size", "pos") if some_large else sent.select("k", "class", "size", "pos", "kind")
    pairs = meet(of_small, of_small, ["k"] if some_large else ["k", "kind"], F.col("a.class") < F.col("b.class"))
    if some_large:
        # A long list lies in parts, and each large set goes through all of them.
        looking = sent.where("kind = 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        lists = sent.where("kind < 3").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
        pairs = pairs.unionAll(meet(looking, lists, ["k", "part"], (F.col("a.class") != F.col("b.class")) & ((F.col("b.kind") != 1) | (F.col("a.class") < F.col("b.class")))))
    pairs = pairs.distinct()
    a, b = sets.select(F.col("class").alias("class_a"), F.col("runs").alias("runs_a")), sets.select(F.col("class").alias("class_b"), F.col("runs").alias("runs_b"))
    both = F.size(F.array_intersect("runs_a", "runs_b"))
    return pairs.join(a, "class_a").join(b, "class_b").where(both >= F.lit(similarity) * (F.size("runs_a") + F.size("runs_b") - both) - F.lit(1e-9)).select("class_a", "class_b")


def near_duplicates(rows: DataFrame, *, key: str = "id", text: str = "content", run: int = RUN, similarity: float = SIMILARITY, least: int = WORDS, boundary: int | None = None, short: int = SHORT, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """(``class_a, class_b``: the pairs of similar classes; ``class, id``: the rows of each class).

    Words are maximal runs of ASCII letters, digits and underscores, without regard to case.  Texts that are null or
    have fewer than ``least`` words take no part, nor do rows with a null key.  Texts with the same set of word
    runs are one class, named by its smallest key; a key that comes with several texts is in several classes.
    Repeated rows count once.  Other columns are ignored.  An empty table gives empty results."""
    sets, members = classes_of(rows, key=key, text=text, run=run, least=least)
    return similar_classes(sets, similarity=similarity, boundary=boundary, short=short, part=part), members


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs, those of equal sets included, as the problem's cases are stated."""
    links, members = near_duplicates(spark.read.parquet(f"{d}/chunks.parquet"))
    a, b = members.toDF("class_a", "id_a"), members.toDF("class_b", "id_b")
    within = a.join(b, (F.col("class_a") == F.col("class_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    across = links.join(a, "class_a").join(b, "class_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return within.unionAll(across)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per chunk that takes part: its class and the number of similar classes."""
    links, members = near_duplicates(spark.read.parquet(f"{d}/chunks.parquet"))
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "class", "left").select("id", F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes}
_RUNS = """
w AS (SELECT id, list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM chunks WHERE content IS NOT NULL),
r AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS r FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 30)),
n AS (SELECT id, count(*) AS n FROM r GROUP BY id)"""
ORACLE = {
    "p2_found": f"""WITH {_RUNS}, o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM r a JOIN r b ON a.r = b.r AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM o JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE o >= 0.7 * (a.n + b.n - o)""",
}
