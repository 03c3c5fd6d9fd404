import numpy as np

from unitquarry.llm import neighbours as N

SCHEMA = "id long, embedding array<float>, other string"


def exact(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -9)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {tuple(sorted((int(ids[i]), int(ids[j])))) for i in range(len(ids)) for j in top[i]}


def pairs(df):
    return {tuple(sorted((r.id, r.other))) for r in df.collect()}


def test_recall_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(500, 64))
    x = np.repeat(centre, 6, 0) + 0.3 * rng.normal(size=(3000, 64))
    x *= rng.uniform(0.5, 2, size=(3000, 1))
    df = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)], SCHEMA)
    monkeypatch.setattr(N, "CELL", 150)
    found, want = pairs(N.nearest(df)), exact(np.arange(3000), x.astype(np.float32))
    assert len(found & want) / len(want) > 0.95
    monkeypatch.setattr(N, "BLOCK", 60)
    monkeypatch.setattr(N, "VISITORS", 90)
    assert len(pairs(N.nearest(df)) & want) / len(want) > 0.95


def test_recall_with_more_cells_than_the_sample_gives(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(500, 64)), 6, 0) + 0.3 * rng.normal(size=(3000, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)], SCHEMA)
    monkeypatch.setattr(N, "CELL", 40)
    index = N.Index(x[:256].astype(np.float32), 3000)
    home, row, cell = index.visits(N._unit(x))
    assert len(index.shifts) == 3 and len(index.centres) == 32 and set(zip(range(3000), home)) <= set(zip(row, cell))
    want = exact(np.arange(3000), x.astype(np.float32))
    assert len(pairs(N.nearest(df, sample_rows=256)) & want) / len(want) > 0.9


def test_unusable_copies_and_few_rows(spark):
    e = np.eye(64)
    rows = [(1, None), (2, []), (3, [0.0] * 64), (4, [1.0] * 32), (5, [float("nan")] * 64)]
    rows += [(10 + i, e[0].tolist()) for i in range(9)]  # nine copies
    rows += [(30, e[1].tolist()), (31, e[1].tolist()), (32, (e[1] + 0.1 * e[2]).tolist())]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    out = N.nearest(df).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r.other)
    assert set(by) == {*range(10, 19), 30, 31, 32}
    assert all(len(v) == len(set(v)) == 5 and i not in v for i, v in by.items())
    assert all(set(by[i]) <= set(range(10, 19)) for i in range(10, 19))
    assert {31, 32} <= set(by[30]) and {30, 31} <= set(by[32])
    assert N.nearest(df.where("id < 6")).count() == 0
    assert N.nearest(df.where("id = 30")).count() == 0
