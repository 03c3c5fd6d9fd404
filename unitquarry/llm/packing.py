"""Filling containers of fixed capacity with items of varying size, by swap-based local search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitquarry.llm.tokens import count_tokens
from unitquarry.session import stored

CAPACITY = 2048
#: Items that are packed together, about; unused space that a finished container may have; share of the items that a round must finish, or it is the last.
SHARD, SLACK, SHRINK = 20_000, 4, 0.05


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items in falling size, each into the container that it fills best; the free spaces are the bits of one number."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    bits = 0
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        fitting = bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                bits &= ~(1 << free)
            bins[b].append(int(i))
        else:
            free, b = capacity, len(bins)
            bins.append([int(i)])
        by_free.setdefault(free - n, []).append(b)
        bits |= 1 << (free - n)
    return bins


def _exchange(give: list[int], take: list[int], free: int, sizes: np.ndarray) -> tuple[list[int], list[int]] | None:
    """The items of ``give`` for the items of ``take`` that fill ``take``'s free space best: a move, one for one, or two for one.

    ``take`` is the fuller one, so whatever it gains raises the sum of the squared fills."""
    g, t = sizes[give], sizes[take]
    best, how = 0, None
    gain = np.where(g <= free, g, 0)
    if len(g) and gain.max() > best:
        best, how = int(gain.max()), ([int(gain.argmax())], [])
    if best < free and len(g) and len(t):
        gain = g[:, None] - t[None, :]
        gain = np.where((gain > best) & (gain <= free), gain, 0)
        if gain.any():
            i, j = np.unravel_index(gain.argmax(), gain.shape)
            best, how = int(gain[i, j]), ([int(i)], [int(j)])
    if best < free and len(g) > 1 and len(t):
        a, b = np.triu_indices(len(g), 1)
        two, order = g[a] + g[b], None
        order = np.argsort(two, kind="stable")
        want = np.searchsorted(two[order], t + free, "right") - 1
        gain = np.where(want >= 0, two[order][np.maximum(want, 0)] - t, 0)
        if gain.max() > best:
            j = int(gain.argmax())
            k = order[want[j]]
            how = ([int(a[k]), int(b[k])], [j])
    return how


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int, slack: int = 0) -> list[list[int]]:
    """Empty the least filled container into the others' free space, again and again, until none can be emptied."""
    fill = [int(sizes[b].sum()) for b in bins]
    tried: set[int] = set()
    while True:
        open_ = sorted((i for i in range(len(bins)) if bins[i] and capacity - fill[i] > slack), key=lambda i: fill[i])
        e = next((i for i in open_ if i not in tried), None)
        if e is None:
            return [b for b in bins if b]
        tried.add(e)
        moved, before = True, fill[e]
        while moved and bins[e]:
            moved = False
            for b in sorted((i for i in open_ if i != e), key=lambda i: -fill[i]):
                if fill[e] <= fill[b] < capacity and (how := _exchange(bins[e], bins[b], capacity - fill[b], sizes)):
                    out, back = [bins[e][i] for i in how[0]], [bins[b][j] for j in how[1]]
                    bins[e] = [x for x in bins[e] if x not in out] + back
                    bins[b] = [x for x in bins[b] if x not in back] + out
                    change = int(sizes[out].sum() - (sizes[back].sum() if back else 0))
                    fill[e], fill[b], moved = fill[e] - change, fill[b] + change, True
                    if not bins[e]:
                        break
        if fill[e] != before:
            tried = {e}  # others may fit now; the sum of squares has grown, so this ends


def pack(items: DataFrame, *, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``container_id, key, piece_no, start, n``: all items in containers of ``capacity``.

    An item above the capacity is cut into pieces of the capacity and a rest; no other item is cut.  Items of no
    size, null sizes among them, go into some container and take no space.  Repeated rows are items of their own.
    Negative sizes raise an error.  Other columns are ignored; an empty table gives an empty result.

    Plan: items fall into shards of bounded size by hash, each packed by one task: best fit first, then local
    search.  Full containers are done; the items of the others are dealt anew to fewer shards, until one shard
    holds them all, or a round fills so few containers that the items can't do better.  So the last, least filled containers
    don't add up over the shards."""
    spark = items.sparkSession
    kind = items.schema[key].dataType.simpleString()
    n = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    checked = F.when(n < 0, F.raise_error(F.lit("an item has a negative size"))).otherwise(n)
    whole = items.select(F.col(key).alias("key"), checked.cast("bigint").alias("n"))
    each = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity)).cast("int")))
    todo = whole.select("key", each.alias("piece_no"), "n").select("key", (F.col("piece_no") + 1).alias("piece_no"), (F.col("piece_no") * F.lit(capacity)).cast("bigint").alias("start"), F.least(F.col("n") - F.col("piece_no") * capacity, F.lit(capacity)).cast("bigint").alias("n"))
    todo = stored(todo.withColumn("mix", F.xxhash64("key", "piece_no", F.monotonically_increasing_id())))
    count = todo.count()
    schema = f"shard bigint, bin bigint, fill bigint, key {kind}, piece_no int, start bigint, n bigint, mix bigint"
    done: DataFrame | None = None

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "mix"], ascending=False, ignore_index=True)
        sizes = pdf["n"].to_numpy(np.int64)
        bins = local_search(best_fit(sizes, capacity), sizes, capacity, SLACK)
        where = np.empty(len(pdf), np.int64)
        for b, members in enumerate(bins):
            where[members] = b
        fill = np.bincount(where, sizes, len(bins)).astype(np.int64)
        return pdf.assign(bin=where, fill=fill[where])[["shard", "bin", "fill", "key", "piece_no", "start", "n", "mix"]]

    turn, before = 0, None
    while True:
        shards = max(1, -(-count // shard))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("mix", F.lit(turn)), F.lit(shards)))
        packed = stored(dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(one, schema))
        last = shards == 1 or (before is not None and count > (1 - SHRINK) * before)
        full = packed if last else packed.where(F.col("fill") >= capacity - SLACK)
        named = full.select((F.lit(turn) * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 24) + F.col("bin")).cast("bigint").alias("container_id"), "key", "piece_no", "start", "n")
        done = named if done is None else done.unionAll(named)
        if last:
            break
        todo = packed.where(F.col("fill") < capacity - SLACK).drop("shard", "bin", "fill")
        turn, before, count = turn + 1, count, todo.count()
    return done.toDF("container_id", key, "piece_no", "start", "n")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Documents in containers of 2,048 tokens; a piece is the tokens from start_token on."""
    return pack(count_tokens(spark.read.parquet(f"{d}/documents.parquet"))).withColumnsRenamed({"start": "start_token", "n": "n_tokens"})


QUERIES = {"p7_containers": p7_containers}
ORACLE: dict[str, str] = {}
