import pytest

from unitquarry.llm import personal as P

PERSONS = "given_name string, surname string, email string"


def place(text, *parts):
    return [(text.index(x), text.index(x) + len(x), kind) for x, kind in parts]


@pytest.fixture(scope="module")
def corpus(spark):
    known = [f"{g} {s}" for g in ("Anselma", "Bertolt", "Corvin", "Dorotea") for s in ("Tannhof", "Ellerbrock", "Quistorp")]
    rows = [f"The build broke again. Reported by {n}. Nobody saw it. The log is long." for n in known for _ in range(2)]
    numbers = [(f"+49 30 5550 {100 + i}", f"030/5550{1000 + i}") for i in range(12)]
    rows += [f"Please call {n[i % 2]} or call {n[1 - i % 2]} for help with part number 903-44-{i}0650{i}." for i, n in enumerate(numbers)]
    rows += [f"User logged in, passport no. ZK{7048106 + i}, status {i}." for i in range(6)]
    own = [
        "Reported by Xaverine Holmbruck. The log is long.",
        "Write to a.b+c@example.org or d-e (at) mail (dot) example (dot) com today.",
        "The customer lives at 12 Mill Race Court, Apt 4B, Nyborough ZQ 07420 and left.",
        "Am 2013-01-16 kam es. Die Anschrift lautet Am Alten Kiln 17a\n00346 Nyborough. Ende.",
        "Nothing here: install pkg@1.2.3, call @Orchard, 10.0.12.77, ISBN 978-0-00-51, Street View.",
        "Please call +49 (0)30 5550 6512 ext. 12.",
    ]
    return [*rows, *own], len(rows)


def test_kinds_and_places(spark, corpus):
    texts, n = corpus
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (0, texts[0], "y")], "doc_id long, text string, kind string")
    persons = spark.createDataFrame([("Anselma", "Tannhof", None), ("Bertolt", "Ellerbrock", None), (None, "Quistorp", None), ("Corvin", None, None), ("Dorotea", None, None)], PERSONS)
    spans = P.find_personal(docs, persons)
    got = {}
    for r in spans.collect():
        got.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos, r.kind))
    t = texts[n:]
    assert got[n] == place(t[0], ("Xaverine Holmbruck", "person"))
    assert sorted(got[n + 1]) == place(t[1], ("a.b+c@example.org", "email"), ("d-e (at) mail (dot) example (dot) com", "email"))
    assert got[n + 2] == place(t[2], ("12 Mill Race Court, Apt 4B, Nyborough ZQ 07420", "address"))
    assert got[n + 3] == place(t[3], ("Am Alten Kiln 17a\n00346 Nyborough", "address"))
    assert n + 4 not in got and got[n + 5] == place(t[5], ("+49 (0)30 5550 6512 ext. 12", "phone"))
    assert all(len(got[i]) == 1 and got[i][0][2] == "person" for i in range(24))
    assert all([k for *_, k in sorted(got[i])] == ["phone", "phone"] for i in range(24, 36))
    assert all([k for *_, k in got[i]] == ["id_number"] for i in range(36, 42))
    clean = {r.doc_id: r.text for r in P.redact(docs.where("doc_id > 0"), spans).collect()}
    assert clean[n] == "Reported by [PERSON]. The log is long." and clean[900] is None and clean[901] == ""
    assert clean[n + 3] == "Am 2013-01-16 kam es. Die Anschrift lautet [ADDRESS]. Ende."


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    persons = spark.createDataFrame([], PERSONS)
    assert P.find_personal(docs, persons).count() == 0


def test_positions_count_code_points():
    text = "😀 ＋４９ mail a＠b.example"
    assert [(c[2], c[3]) for c in P.candidates(1, text) if c[1] == "e"] == [(text.index("a＠"), len(text))]
