import random
import re

import pandas as pd
import pytest

from unitquarry.llm import neardup as N

SCHEMA = "id long, content string, class long"


def brute(rows, similarity=0.7, least=30):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9_]+", "".join(c.lower() if c.isascii() else "☃" for c in t or ""))
        if len(w) >= least:
            sets[i] = {*zip(w, w[1:], w[2:])}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def expanded(links, members):
    by = {}
    for r in members.collect():
        by.setdefault(r["class"], []).append(r.id)
    out = {tuple(sorted((a, b))) for m in by.values() for a in m for b in m if a != b}
    return out | {tuple(sorted((a, b))) for r in links.collect() for a in by[r.class_a] for b in by[r.class_b]}


def corpus(seed, n=140):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([30, 34, 60, 200]))] for _ in range(n // 7)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice(words)]
        rows.append((i, rng.choice([" ", "\r\n", ", "]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return rows


@pytest.mark.parametrize(("boundary", "short"), [(0, 32), (40, 3), (40, 0), (10_000, 0), (10_000, 5), (None, 32)])
def test_all_pairs_whatever_the_boundary(spark, boundary, short):
    rows = corpus(5)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    want = brute(rows)
    assert len(want) > 100 and expanded(*N.near_duplicates(df, boundary=boundary, short=short, part=5)) == want


def test_odd_rows(spark):
    t = " ".join(f"word{i}" for i in range(40))
    rows = [(1, t), (2, t.upper()), (3, None), (4, ""), (5, "a b c"), (None, t), (2, t.upper()), (6, t + " K"), (7, "x " * 100_000), (8, "x " * 99)]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert expanded(*N.near_duplicates(df)) == {(1, 2), (1, 6), (2, 6), (7, 8)}
    links, members = N.near_duplicates(df.limit(0))
    assert links.count() == members.count() == 0


def test_the_boundary_follows_the_cost():
    def of(*rows):
        return pd.DataFrame(rows, columns=["size", "large_rows", "large_links", "small_rows", "small_links"])

    assert N.choose_boundary(of((30, 10, 20, 10, 20), (100, 30, 60, 30, 60))) == 100  # short lists only: no pairs are sent
    assert N.choose_boundary(of((30, 10, 9000, 40, 20), (100, 30, 900, 400, 60))) == 30  # the many pairs of large sets cost more than their lists
    assert N.choose_boundary(of((30, 10, 90, 40, 20), (100, 30, 900, 400, 60))) == 0
    assert N.choose_boundary(of()) == 0


def test_both_halves_give_pairs(spark):
    """Texts of few words that all have in common, small and large: long lists, of which pairs of runs are sent for the small ones."""
    rng = random.Random(9)
    common = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(common) for _ in range(n))) for i, n in enumerate([40] * 60 + [400] * 12)]
    rows += [(100 + i, t + " w1 w2") for i, t in rows[::6]]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    want = brute(rows)
    assert {a < 60 for a, _ in want} == {True, False} and expanded(*N.near_duplicates(df, boundary=60, short=4, part=7)) == want
