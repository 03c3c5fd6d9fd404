"""The k most similar vectors of every vector, by additive quantisation and exact reranking.

A bounded sample gives coarse cells and full-dimensional residual codebooks; every vector is encoded by beam search
and indexed.  Cells are searched independently: lookup tables and stored norms score all members of a cell for a
query, the best are reranked by their exact cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIM, K = 64, 5
#: Rows of the sample that the index is fitted on, at most; wanted members of a cell; members and visitors that meet in one task, at most (as the sample foresees them).
SAMPLE, CELL, BLOCK, VISITORS = 32768, 6000, 16000, 32768
#: Keys that the copies of one vector are spread over.
SALTS = 8
#: Tasks that search cells, for each partition of a shuffle.
SPREAD = 4
#: Shifts of the centres, at most, where there are more cells than the sample can give.
SHIFTS = 256
#: Codebooks, codewords of each, width of the beam, candidates reranked for a query and cell.
BOOKS, WORDS, BEAM, RERANK = 6, 256, 4, 32
#: A query visits the cells whose centre is at most this much less similar to it than the nearest centre.
MARGIN = 0.08


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, sphere: bool) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        label = (x @ c.T - (0 if sphere else 0.5 * (c**2).sum(1))).argmax(1)
        order = np.argsort(label, kind="stable")
        used, begin = np.unique(label[order], return_index=True)
        sums = np.add.reduceat(x[order], begin)
        c[used] = sums / (np.linalg.norm(sums, axis=1)[:, None] if sphere else np.diff([*begin, len(x)])[:, None])
    return c


class Index:
    """Centres, codebooks, and the blocks of members and of visitors of the cells; its size doesn't grow with the rows beyond the sample's."""

    def __init__(self, sample: np.ndarray, rows: int):
        rng = np.random.default_rng(7)
        x = _unit(sample)
        cells = max(1, min(round(rows / CELL), len(x) // 8))
        self.centres = _kmeans(x, cells, 12, rng, True)
        # More cells than the sample can give are made of the centres and of shifts that all of them share.
        rest = x - self.centres[(x @ self.centres.T).argmax(1)]
        shifts = min(SHIFTS, -(-round(rows / CELL) // cells))
        self.shifts = _kmeans(rest, shifts, 12, rng, False) if shifts > 1 else np.zeros((1, x.shape[1]), np.float32)
        home, _, cell = self.visits(x)
        least = lambda c, size: np.maximum(1, np.ceil(np.bincount(c, minlength=len(self.centres) * len(self.shifts)) / len(x) * rows / size)).astype(np.int64)
        self.blocks, self.visitors = least(home, BLOCK), least(cell, VISITORS)
        rest, self.books = x - self.centres[home // len(self.shifts)], []
        for _ in range(BOOKS):
            book = _kmeans(rest, WORDS, 8, rng, False)
            self.books.append(book)
            rest = rest - book[(rest @ book.T - 0.5 * (book**2).sum(1)).argmax(1)]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the vectors and half the squared norms of what the codes stand for, by beam search over the books."""
        n = len(x)
        rest = (x - self.centres[home // len(self.shifts)])[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        every = np.arange(n)[:, None]
        for book in self.books:
            # how much each codeword would take off the squared error of each partial code
            error = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, rest.shape[2]) @ book.T).reshape(n, rest.shape[1], -1) + (book**2).sum(1)
            flat = error.reshape(n, -1)
            best = np.argpartition(flat, BEAM - 1, axis=1)[:, :BEAM] if flat.shape[1] > BEAM else np.broadcast_to(np.arange(flat.shape[1]), flat.shape)
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
            parent, word = best // len(book), best % len(book)
            rest = rest[every, parent] - book[word]
            codes = np.concatenate([codes[every, parent], word[:, :, None].astype(np.uint8)], 2)
        return codes[:, 0], 0.5 * ((x - rest[:, 0]) ** 2).sum(1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home cells, and (row, cell) of all visits: the cells whose middle is at most MARGIN less similar than the nearest one."""
        z = x @ self.centres.T
        row, centre = np.nonzero(z >= z.max(1)[:, None] - MARGIN)
        if len(self.shifts) == 1:
            return z.argmax(1), row, centre
        # half the squared distance to a centre with a shift is 1 less this
        near = z[row, centre][:, None] + (x @ self.shifts.T)[row] + (0.5 - 0.5 * ((self.centres[centre][:, None, :] + self.shifts[None]) ** 2).sum(2))
        begin = np.searchsorted(row, np.arange(len(x)))
        best = np.maximum.reduceat(near.max(1), begin)
        pick, shift = np.nonzero(near >= best[row][:, None] - MARGIN)
        row, cell, score = row[pick], centre[pick] * len(self.shifts) + shift, near[pick, shift]
        order = np.lexsort((cell, -score, row))
        return cell[order][np.searchsorted(row, np.arange(len(x)))], row, cell


def _search(index: Index, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, q_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, member row, cosine) of the reranked candidates of all queries, without a query itself."""
    n, lanes = len(ids), 32
    pad = -n % lanes
    slots = [np.concatenate([codes[:, m], np.zeros(pad, np.uint8)]).astype(np.int64) for m in range(codes.shape[1])]
    base = -np.concatenate([norms, np.full(pad, np.inf, np.float32)]).astype(np.float32)
    out = []
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        # scores lie member by query: a table row holds one codeword's products with all queries of the batch
        score = np.repeat(base[:, None], len(q), 1)
        for m, book in enumerate(index.books):
            score += (book @ q.T)[slots[m]]
        lane = score.reshape(-1, lanes, len(q))
        top = min(RERANK, lane.shape[0])
        groups = np.argpartition(-lane.max(1), top - 1, axis=0)[:top]
        near = lane[groups, :, np.arange(len(q))]  # groups x queries x lanes
        near = near.transpose(1, 0, 2).reshape(len(q), -1)
        take = min(RERANK, near.shape[1])
        best = np.argpartition(-near, take - 1, axis=1)[:, :take]
        member = groups.T[np.arange(len(q))[:, None], best // lanes] * lanes + best % lanes
        row, col = np.nonzero((member < n) & (ids[np.minimum(member, n - 1)] != q_ids[at : at + 256, None]))
        member = member[row, col]
        out.append((row + at, member, np.einsum("ij,ij->i", q[row], vectors[member])))
    return tuple(np.concatenate(x) for x in zip(*out))


def _best(source: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best different others of each source; ties go to the smaller other."""
    order = np.lexsort((other, -score, source))
    s, o = source[order], other[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    order, s = order[fresh], s[fresh]
    start = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1] if len(s) else np.zeros(0, int)
    rank = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    return order[rank < k]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... of each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _repeated(counts: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    return [np.repeat(c, counts) for c in columns]


def nearest(rows: DataFrame, *, key: str = "id", vector: str = "embedding", dim: int = DIM, k: int = K, sample_rows: int = SAMPLE) -> DataFrame:
    """``key, other, cosine``: for every usable vector ``k`` others of the highest cosine, found approximately.

    Vectors that are null, not of ``dim`` numbers, all zero, or with a null or non-finite number take no part.
    Equal vectors are one class, indexed once: a member's own copies come first (the ``k`` smallest keys besides
    its own), then the members of the nearest classes, smallest keys first.  Keys are taken to be unique; of rows
    that repeat a key with the same vector nothing is lost.  Other columns are ignored.  Fewer than ``k`` others
    give fewer rows; an empty table gives none.

    Plan: copies collapse in a map-side aggregate; each class is sent once to its home cell, with its code, and
    once to each cell whose centre is nearly as near.  A pair that meets in any cell counts for both its ends, so
    a neighbour is missed only if neither end visits the other's cell.  Members and visitors of a cell meet block by block, so
    that tasks are bounded.  Cells stay at CELL members up to SHIFTS times ``sample_rows`` / 8 of them."""
    spark = rows.sparkSession
    usable = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vec")).where(
        F.col("id").isNotNull() & (F.size("vec") == dim) & F.exists("vec", lambda x: x != 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    hashed = usable.withColumns({"h": F.xxhash64("vec"), "g": F.xxhash64(F.lit(1), "vec")})
    first = Window.partitionBy("h", "g").orderBy("id")
    copies = hashed.select("h", "g", "id").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    classes = copies.groupBy("h", "g").agg(F.array_sort(F.collect_list("id")).alias("own"))
    several = classes.where(F.size("own") > 1)
    kinds = hashed.groupBy("h", "g").agg(F.min("id").alias("id"), F.any_value("vec").alias("vec")).join(several, ["h", "g"], "left").select("id", "vec", "own")

    total = hashed.select("h", "g").distinct().count()
    schema = f"{key} bigint, other bigint, cosine float"
    if not total:
        return spark.createDataFrame([], schema)
    sample = usable.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20)) < F.lit(int(min(1.0, 1.2 * sample_rows / total) * (1 << 20)) + 1)).orderBy(F.xxhash64(F.lit(4), "id"), "id").limit(sample_rows).select("vec").toArrow()
    if not len(sample):
        sample = usable.limit(sample_rows).select("vec").toArrow()
    shared = spark.sparkContext.broadcast(Index(_matrix(sample.column(0).combine_chunks()), total))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for at in range(0, len(whole), 2048):
                batch = whole.slice(at, 2048)
                if not len(batch):
                    continue
                x, ids = _unit(_matrix(batch.column(1))), batch.column(0).to_numpy()
                home, row, cell = index.visits(x)
                codes, norms = index.encode(x, home)
                # A visitor is in one block of visitors, which meets each block of members; a member meets each block of
                # visitors.  Where a vector meets itself so, one row stands for both.
                own_block, own_visit = ids % index.blocks[home], (ids >> 3)
                v_row, v_cell = _repeated(index.blocks[cell], row, cell)
                v_block, v_visit = _within(index.blocks[cell]), own_visit[v_row] % index.visitors[v_cell]
                both = (v_cell == home[v_row]) & (v_block == own_block[v_row])
                (m_row,), m_visit = _repeated(index.visitors[home], np.arange(len(x))), _within(index.visitors[home])
                other = m_visit != own_visit[m_row] % index.visitors[home[m_row]]
                m_row, m_visit = m_row[other], m_visit[other]
                row, cell = np.concatenate([v_row, m_row]), np.concatenate([v_cell, home[m_row]])
                block = np.concatenate([v_block * 4096 + v_visit, own_block[m_row] * 4096 + m_visit])
                visit = np.arange(len(row)) < len(v_row)
                member = np.concatenate([both, np.ones(len(m_row), bool)])
                code = np.concatenate([codes, norms.astype("<f4").view(np.uint8).reshape(-1, 4)], 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell * (1 << 28) + block),
                        pa.array(ids[row]),
                        pa.array([v.tobytes() for v in x[row]], pa.binary()),
                        pa.array([code[r].tobytes() if m else None for r, m in zip(row, member)], pa.binary()),
                        batch.column(2).take(pa.array(row)),
                        pa.array(visit),
                    ],
                    ["cell", "id", "vec", "code", "own", "visit"],
                )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        index = shared.value
        ids, own = pdf["id"].to_numpy(), pdf["own"].to_numpy()
        x = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(len(pdf), -1)
        members, visitors = np.flatnonzero(pdf["code"].notna()), np.flatnonzero(pdf["visit"])
        if not len(members) or not len(visitors):
            return pd.DataFrame(columns=["id", "own", "other", "others", "cosine"])
        raw = np.frombuffer(b"".join(pdf["code"].iloc[members]), np.uint8).reshape(len(members), -1)
        q, m, score = _search(index, ids[members], x[members], raw[:, :-4], raw[:, -4:].copy().view("<f4")[:, 0], ids[visitors], x[visitors])
        q, m = visitors[q], members[m]
        a, b, s = np.concatenate([q, m]), np.concatenate([m, q]), np.concatenate([score, score])
        keep = _best(ids[a], ids[b], s, k)
        a, b = a[keep], b[keep]
        return pd.DataFrame({"id": ids[a], "own": own[a], "other": ids[b], "others": own[b], "cosine": s[keep]})

    placed = kinds.mapInArrow(place, "cell bigint, id bigint, vec binary, code binary, own array<bigint>, visit boolean")
    # Cells are few and cost much, so that they are dealt to more tasks than rows need: else some tasks get several cells and others none.
    dealt = placed.repartition(SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")), "cell")
    found = dealt.groupBy("cell").applyInPandas(search, "id bigint, own array<bigint>, other bigint, others array<bigint>, cosine float")
    found = found.repartition("id").dropDuplicates(["id", "other"])
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    # Where copies are involved, the members of the nearest classes take the places that the own copies leave.
    mixed = best.withColumn("_mixed", F.max(F.col("own").isNotNull() | F.col("others").isNotNull()).over(Window.partitionBy("id")))
    single = mixed.where(~F.col("_mixed")).select("id", "other", "cosine")
    each = mixed.where("_mixed").select("id", "own", "cosine", "_r", F.explode(F.coalesce("others", F.array("other"))).alias("other"))
    places = F.lit(k + 1) - F.coalesce(F.size("own"), F.lit(1))
    each = each.withColumn("_p", F.row_number().over(Window.partitionBy("id").orderBy("_r", "other"))).where(F.col("_p") <= F.when(F.col("own").isNull(), F.lit(k)).otherwise(places))
    others = each.select(F.explode(F.coalesce("own", F.array("id"))).alias("id"), "other", "cosine")
    salted = several.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    within = hashed.select("h", "g", "id", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("_s")).join(salted, ["h", "g", "_s"]).select("id", F.explode(F.slice(F.array_remove("own", F.col("id")), 1, k)).alias("other"), F.lit(1.0).cast("float").alias("cosine"))
    return single.unionAll(others).unionAll(within).toDF(key, "other", "cosine")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(spark.read.parquet(f"{d}/chunks.parquet"))
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


QUERIES = {"p3_found": p3_found}
ORACLE: dict[str, str] = {}
