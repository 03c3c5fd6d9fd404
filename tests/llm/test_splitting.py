import random
import re

from unitquarry.llm import splitting as S


def units(t):
    return len(t.encode("utf-16-le")) // 2


def check(text, pieces, limit, overlap, base):
    """Pieces within the limit, overlaps as stated, the whole text covered, start lines right."""
    raw = text.encode("utf-16-le")
    starts = [0, *[len(text[: m.end()].encode("utf-16-le")) // 2 for m in re.finditer(r"\r\n|\n|\r", text)]]
    at, end = 0, 0
    for n, (line, piece) in enumerate(pieces):
        assert 0 < units(piece) <= limit
        if n:
            s = [x for x in starts if end - overlap <= x < end] if end in starts else []
            at = s[0] if s else end - overlap
            if raw[2 * at + 1 : 2 * at + 2] and 0xDC <= raw[2 * at + 1] <= 0xDF:
                at += 1
        assert raw[2 * at : 2 * (at + units(piece))].decode("utf-16-le") == piece, n
        assert line == base + sum(x <= at for x in starts) - 1
        end = at + units(piece)
    assert end == units(text)


def source(rng, n):
    lines = ["procedure A;", "begin", "  X := 'it''s {';", "end;", "", "{ note", "  still }", "  // 😀 done", "type", "  T = class", "  (* a", "b *)"]
    return "".join(rng.choice(lines) + rng.choice(["\n", "\r\n", "\r\n"]) for _ in range(n))


def test_pieces_cover_the_text(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE", 700)
    monkeypatch.setattr(S, "STRETCH", 3)
    rng = random.Random(1)
    texts = [source(rng, n) for n in (5, 60, 200, 700)] + ["x" * 3000, "😀" * 1500, "ab;" * 900 + "\n" + "y" * 2000, "\n" * 2500, "é " * 1200, "a" * 499 + "\r\n" + "b" * 700]
    rows = [(i, t, 10 * i, "other") for i, t in enumerate(texts)]
    out = S.split_oversized(spark.createDataFrame(rows, "id long, content string, start_line int, text string"), limit=500, overlap=60).collect()
    for i, t, base, _ in rows:
        mine = sorted((r.piece_no, r.start_line, r.content) for r in out if r.id == i)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        check(t, [m[1:] for m in mine], 500, 60, base) if units(t) > 500 else None
        assert (len(mine) > 1) == (units(t) > 500)


def test_cuts_prefer_declarations(spark):
    text = ("procedure P;\nbegin\n" + "  Call(1);\n" * 20 + "end;\n\n") * 6
    out = S.split_oversized(spark.createDataFrame([(1, text, 0)], "id long, content string, start_line int"), limit=600, overlap=50).orderBy("piece_no").collect()
    assert len(out) > 2 and all(r.content.rstrip().endswith("end;") for r in out)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", None), (None, "z" * 30, None), (4, "a\n" * 20, 1), (4, "a\n" * 20, 1)], "id long, content string, start_line int")
    out = S.split_oversized(df, limit=20, overlap=4).collect()
    assert [r.piece_no for r in out if r.id in (1, 2)] == [1, 1]
    four = [r for r in out if r.id == 4]
    assert len(four) == 2 * four[0].pieces and {r.start_line for r in four if r.piece_no == 1} == {1}
    assert all(r.start_line is None for r in out if r.id is None) and len([r for r in out if r.id is None]) == 2
    assert S.split_oversized(df.limit(0)).count() == 0


def test_files_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RANGE", 700)
    text = source(random.Random(2), 400)
    path = tmp_path / "a.pas"
    path.write_bytes(text.encode())
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, size long")
    out = S.split_ranges(S.file_ranges(spark, files), limit=500, overlap=60).orderBy("piece_no").collect()
    check(text, [(r.line_no, r.text) for r in out], 500, 60, 0)
