import numpy as np
import pytest

from unitquarry.llm import packing as P
from unitquarry.llm import tokens as T

TEXTS = [None, "", " ", "a", "Hello  world\r\n\r\n  x 12345 don't", "<|endoftext|> as text", "naïve café Ünïcode  nbsp　wide", "😀😀 👩‍👩‍👧", "​ zero\u0085next\x1c\x1d", "x" * 5000, "   \n\n \t end   ", "ᾀ ½ ② ३ 한국 日本語", "\U0001fae8 new in a later Unicode", "�￾ ퟿", "a", "a"]


def test_ids_equal_the_tokenizer(spark):
    df = spark.createDataFrame([(i % 14, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string, block int")
    want = sorted((i % 14, ids) for i, ids in enumerate(T._encoder(f"{T.VOCABULARIES}/{T.TOKENIZER}")([t or "" for t in TEXTS])))
    for block in (T.BLOCK, 50):
        assert sorted((r.doc_id, r.ids) for r in T.encode_corpus(df, block=block).collect()) == want
        assert sorted((r.doc_id, r.n_tokens) for r in T.count_tokens(df, block=block).collect()) == sorted((i, len(ids)) for i, ids in want)
    assert T.encode_corpus(df.limit(0)).count() == 0


def test_decoding_is_the_inverse(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = T.decode_ids(T.encode_corpus(df), T.pieces(spark)).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}


def fills(rows, capacity):
    by = {}
    for r in rows:
        by[r.container_id] = by.get(r.container_id, 0) + r.n
    assert max(by.values()) <= capacity
    return by


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(30, 90, 3000)] + [0, 0, 100, 101, 250]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)] + [(7, None, "x")], "doc_id long, n_tokens int, n string")
    out = P.pack(df, capacity=100, shard=400).collect()
    by = fills(out, 100)
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece_no)):
        got.setdefault(r.doc_id, []).append((r.start, r.n))
    assert got[3004] == [(0, 100), (100, 100), (200, 50)] and got[3003] == [(0, 100), (100, 1)]
    assert sum(by.values()) == sum(sizes) and len(out) == len(sizes) + 1 + 3
    one = len(P.best_fit(np.array(sorted(x for x in sizes if x <= 100)), 100))
    assert len(by) <= one * 1.01 + 6


def test_local_search_frees_containers():
    sizes = np.array([6, 4, 4, 3, 3, 5, 5, 5, 5])
    bins = P.local_search([[0, 3], [1, 2], [4], [5], [6], [7], [8]], sizes, 10)
    assert len(bins) == 4 and sorted(i for b in bins for i in b) == list(range(9)) and all(sizes[b].sum() <= 10 for b in bins)


def test_odd_items(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 2)], "doc_id long, n_tokens int")
    assert sorted((r.doc_id or 0, r.n) for r in P.pack(df, capacity=10).collect()) == [(0, 2), (1, 5), (1, 5)]
    assert P.pack(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="negative"):
        P.pack(spark.createDataFrame([(1, -5)], "doc_id long, n_tokens int")).collect()
