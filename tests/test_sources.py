import pytest

from unitquarry.functions import text as T
from unitquarry.operators import chunker, diagnostics, parsing, scopes


def chunks(text):
    return [(c[0], c[1], c[2], c[4], c[5]) for c in chunker.chunk_unit(text, "U")[1:]]


def test_chunks_of_a_unit():
    text = """unit U;

interface

type
  TA = class
  private
    FX: Integer;
  strict protected
    FY: Integer;
  published
    property X: Integer;
  end;

  TB = class;
function Get(A: Integer;
  B: Integer): Integer;

implementation

function Get(A: Integer; B: Integer): Integer;
begin
  if A > B then begin
    Result := 1; // begin
  end;
end;

end.
"""
    assert chunks(text) == [("interface", "type", "TA", 5, "published"), ("interface", "routine", "Get", 15, "public"), ("implementation", "routine", "Get", 20, "private")]
    got = chunker.chunk_unit(text, "U")
    assert got[0][:3] == ("header", "unit_header", "U") and got[0][3].count("\n") == 27
    assert got[2][3] == "function Get(A: Integer;" and got[3][3].endswith("end;\nend;")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        # an opening line isn't looked at for its end, so a record in one line runs on
        ("type\n  TR = record X: Integer; end;\n  Y = Integer;\n  TS = class\n  end;\nconst A = 1;\n", [("TR", 4)]),
        # a nested class opens no level, a nested record does
        ("type\n  TC = class\n    R: record\n      A: Integer;\n    end;\n    B: Integer;\n  end;\n", [("TC", 6)]),
        # an empty descendant is no forward declaration and swallows what follows
        ("type\n  EFoo = class(Exception);\n  TBar = class\n    A: Integer;\n  end;\n", [("EFoo", 4)]),
        # a generic and a packed type are known, a short block is dropped but its lines are used up
        ("type\n  TG<T> = class\n    FItem: T;\n  end;\n  P = packed record\n  end;\n", [("TG", 3), ("P", 2)]),
        ("type\n  S = class\n end;\nfunction Later: Integer;\n", [("Later", 1)]),
        # a brace comment over lines is not seen
        ("type\n  TK = class\n    { one\n    end; two }\n    A: Integer;\n  end;\n", [("TK", 3)]),
    ],
)
def test_quirks_of_types(body, want):
    got = [(c[2], c[3].count("\n") + 1) for c in chunker.chunk_unit("unit U;\ninterface\n" + body, "U")[1:]]
    assert got == want or [g for g in got if g[0] != "S"] == want


def test_quirks_of_routines():
    text = "implementation\nprocedure A;\nbegin\n  try\n    X;\n  end;\n  Y;\nend;\nprocedure B; external;\nprocedure C;\nbegin\nend;\n"
    got = [(c[2], c[4], c[3].count("\n") + 1) for c in chunker.chunk_unit(text, "U")[1:]]
    assert got == [("A", 1, 5), ("B", 8, 4)]
    swallowed = "interface\ntype\n  EFoo = class(Exception);\nimplementation\nprocedure P(A: Integer);\nbegin\nend;\nprocedure Q(A: Integer);\nbegin\nend;\n"
    assert [(c[0], c[2]) for c in chunker.chunk_unit(swallowed, "U")[1:]] == [("interface", "EFoo"), ("interface", "Q")]
    assert chunker.chunk_unit("", "U") == [("header", "unit_header", "U", "", 0, None)]


def test_chunk_files_ordinals_and_resume(spark):
    unit = "unit U;\ninterface\nprocedure Alpha;\nprocedure Beta;\nprocedure Gamma;\n"
    rows = [(1, "l", "1", "b/U.pas", unit), (2, "l", "1", "a/V.pas", unit), (3, "l", "1", "c.pas", None), (4, "m", None, "c.pas", "")]
    placed = chunker.ordinals(chunker.chunk_files(spark.createDataFrame(rows, "file_id long, library string, version string, file_path string, source_text string")))
    got = sorted((r.library, r.place, r.file_id, r.ordinal) for r in placed.collect())
    assert got == [("l", n + 1, 2 if n < 4 else 1, n % 4) for n in range(8)] + [("m", 1, 4, 0)]
    have = spark.createDataFrame([("l", "1", 3)], "library string, version string, chunks long")
    assert sorted(r.place for r in chunker.to_index(placed, have).where("library = 'l'").collect()) == [4, 5, 6, 7, 8]
    assert sorted(r.place for r in chunker.to_index(placed, have, most=5, batch=2).where("library = 'l'").collect()) == [4, 5]
    assert chunker.to_index(placed, have, most=3).where("library = 'l'").count() == 0


def test_lines_and_names(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n", r"C:\x\Unit.One.pas"), ("\ufeff", "/y/.pas"), ("x\n\n", "name"), ("", ""), (None, None)], "t string, p string")
    from pyspark.sql import functions as F

    got = df.select(T.lines(F.col("t")).alias("l"), T.unit_name(F.col("p")).alias("u")).collect()
    assert [r.l for r in got] == [["a", "b", "c"], [], ["x", ""], [], None]
    assert [r.u for r in got] == ["Unit.One", ".pas", "name", "", None]


def test_tokens_make_up_the_text():
    text = "x := 1..10; (*) y (*$IFDEF A*) 'it''s' {c} // e\r\n'open\n {$X"
    found = parsing.scan(text)
    assert "".join(t for _, t, _ in found) == text
    assert [(k, t) for k, t, _ in found if k in ("number", "comment", "directive", "string")] == [
        ("number", "1..10"), ("comment", "(*)"), ("directive", "(*$IFDEF A*)"), ("string", "'it''s'"), ("comment", "{c}"), ("comment", "// e\r"), ("string", "'open\n {$X"),
    ]


def test_regions_and_their_diagnostics(spark):
    rows = [(1, "{$IFDEF A}{$IFNDEF B}{$ENDIF}{$ELSE}{$ENDIF}"), (2, "{$ENDIF}{$IFOPT C+}\n{$IFEND}{$ENDIF}"), (3, "{$IF x > 1}{$ifdef D}{$endif}"), (4, None), (5, "")]
    found = parsing.tokens(spark.createDataFrame(rows, "file_id long, source_text string"), only=("directive",))
    closed, wrong = parsing.regions(parsing.directives(found))
    assert sorted((r.file_id, r.directive, r.condition, r.start_line, r.end_line, r.depth) for r in closed.collect()) == [
        (1, "IFDEF", "A", 1, 1, 1), (1, "IFNDEF", "B", 1, 1, 2), (2, "IFOPT", "C+", 1, 2, 1), (3, "IFDEF", "D", 1, 1, 2),
    ]
    assert sorted((r.file_id, r.code, r.directive) for r in wrong.collect()) == [(2, "DP2001", "ENDIF"), (2, "DP2001", "ENDIF"), (3, "DP2002", "IF")]


def test_structure_symbols_and_uses(spark):
    text = "unit Alpha;\ninterface\nuses System.SysUtils, Beta in 'b.pas', system.sysutils;\ntype\n  TA = class\n    procedure P;\n  end;\n  TB = record end;\ntype TC = interface end;\nimplementation\nuses Gamma;\nend."
    found = parsing.nodes(spark.createDataFrame([(1, text), (2, "interface"), (3, "")], "file_id long, source_text string"))
    got = [(r.id, r.parent_id, r.kind, r.name) for r in found.where("file_id = 1").collect()]
    assert got[:3] == [("n1", None, "unit", "Alpha"), ("n2", "n1", "interface_section", "interface"), ("n3", "n2", "uses", "System.SysUtils")]
    assert [(k, n) for _, _, k, n in got[5:]] == [("class", "TA"), ("interface_type", "TC"), ("implementation_section", "implementation"), ("uses", "Gamma")]
    assert sorted((r.name, r.kind, r.signature) for r in parsing.symbols(found).collect()) == [("Alpha", "unit", "unit Alpha;"), ("TA", "class", "TA = class;"), ("TC", "interface", "TC = interface;")]
    assert sorted((r.section, r.unit) for r in parsing.used_units(found).collect()) == [("implementation", "Gamma"), ("interface", "Beta"), ("interface", "System.SysUtils")]
    assert [r.name for r in found.where("file_id > 1 and kind = 'unit'").collect()] == ["<unknown-unit>"] * 2


def test_normal_form():
    a, b = "unit  A;\r\ninterface\r\nvar x,y:Integer;  \r\n", "unit A; interface var\n x , y : Integer;"
    assert parsing.normal_form(a) == parsing.normal_form(b) == "unit A;\ninterface\nvar x, y:Integer;"
    assert parsing.normal_form("a {$IFDEF X} b {$ENDIF}") == "a\n{$IFDEF X}\nb\n{$ENDIF}"
    assert parsing.normal_form("a {c} b // d\nc", comments=False) == "a b c" and parsing.normal_form(" \n") == ""


def test_diagnostics(spark):
    row = lambda f, c, s, line, hint=None: (f, c, s, "m", (line, 1, line, 2), hint)
    rows = [row(1, "A", "info", 1), row(1, "A", "INFO", 1, ""), row(1, "B", "Error", 9), row(1, "C", "warning", 2)] + [row(2, "A", "Info", i) for i in range(5)] + [(3, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "file_id long, code string, severity string, message string, span struct<start_line: int, start_column: int, end_line: int, end_column: int>, recovery_hint string")
    assert [(r.code, r.pos) for r in diagnostics.ordered(df).where("file_id = 1").orderBy("pos").collect()] == [("B", 1), ("C", 2), ("A", 3)]
    got = {r.file_id: (r.total, r.returned, r.errors, r.warnings, r.infos, r.truncated) for r in diagnostics.report(df, most=3).collect()}
    assert got == {1: (3, 3, 1, 1, 1, False), 2: (5, 3, 0, 0, 5, True), 3: (1, 1, 0, 0, 0, False)}
    with pytest.raises(ValueError):
        diagnostics.ordered(df, most=0)


def test_scopes(spark):
    s = spark.createDataFrame([("p", 0, "Rtl", "12.0"), ("p", 1, "rtl", "12.0"), ("p", 2, "RTL", "13.1"), ("p", 3, None, "1"), ("p", 4, "x", " ")], "profile_id string, scope_no int, library string, version string")
    assert [(r.library, r.pos, r.versions) for r in scopes.grouped(s).collect()] == [("Rtl", 0, ["12.0", "13.1"])]
    q = spark.createDataFrame([("a", "RTL", None), ("b", "rtl", "9"), ("c", None, None), ("d", " ", "7")], "query_id string, library string, version string")
    d = spark.createDataFrame([("rtl", "1", 1), ("rtl", "2", 3), ("rtl", "3", 2), ("vcl", "5", 9)], "library string, version string, released_at int")
    got = sorted((r.query_id, r.library, r.version, r.pos) for r in scopes.expanded(q, d, most=2).collect())
    assert got == [("a", "RTL", "2", 1), ("a", "RTL", "3", 2), ("b", "rtl", "9", 1), ("c", "rtl", "2", 1), ("c", "vcl", "5", 1), ("d", "rtl", "2", 1), ("d", "vcl", "5", 1)]


def test_reports_and_declaring_types(spark):
    files = spark.createDataFrame([(1, "unit A;\ninterface\ntype\n  T = class\n  end;\n  U = record\n  end;\n"), (2, "begin"), (3, None)], "file_id long, source_text string")
    got = {r.file_id: (r.unit_name, r.nodes, r.symbols, r.returned_symbols, r.truncated, r.code) for r in parsing.unit_report(files, most_symbols=2).collect()}
    assert got == {1: ("A", 4, 3, 2, True, None), 2: (None, 1, 0, 0, False, "DP3001")}
    place = (0, 0, 0, 0)
    tree = [(1, "a", None, "unit", "A", *place, None), (1, "b", "a", "class", "B", *place, None), (1, "c", "b", "method", "C", *place, None), (1, "d", "c", "method", "D", *place, None), (1, "e", "gone", "method", "E", *place, None)]
    out = parsing.declaring_types(spark.createDataFrame(tree, parsing.NODES))
    assert {r.id: r.declaring_type for r in out.collect()} == {"a": None, "b": None, "c": "B", "d": "B", "e": None}
    with pytest.raises(Exception, match="two nodes of one id"):
        parsing.declaring_types(spark.createDataFrame([*tree, tree[0]], parsing.NODES)).collect()


def test_parse_results_are_nested_cut_and_written_as_text(spark):
    files = spark.createDataFrame([(1, "unit A;\ninterface\ntype\n  T = class\n  end;\n"), (2, ""), (3, None)], "file_id long, source_text string")
    got = {r.file_id: r for r in parsing.parse_results(files, most_nodes=2, most_symbols=5).collect()}
    assert set(got) == {1, 2} and [n.kind for n in got[1].nodes] == ["unit", "interface_section"] and got[1].nodes_truncated and not got[1].symbols_truncated
    assert [s.signature for s in got[1].symbols] == ["unit A;", "T = class;"] and [d.code for d in got[2].diagnostics] == ["DP3001"] and not got[2].symbols
    text = parsing.as_json(parsing.parse_results(files)).where("file_id = 2").first().json
    assert '"unit_name":null' in text and '"kind":"unit"' in text and '"severity":"Warning"' in text


DEEP = """unit A;
interface
type
  TEnum = (a, b);
  TBase = class;
  TOuter = class(TBase, IThing)
    FSize: Integer;
  strict private
    type
      TInner = record
        X: record Y: Integer; end;
        procedure Reset;
      end;
    class procedure Load(const A: TInner; B: Integer); static;
  published
    property Size: Integer read FSize;
    function Name: string;
  end;
  THelp = class helper for TOuter
    procedure More;
  end;
  IFoo = interface
    procedure Run;
  end;
procedure Alone;
implementation
end.
"""


def test_members_of_types_as_symbols(spark):
    files = spark.createDataFrame([(1, DEEP), (2, "unit B; interface type T = class"), (3, "")], "file_id long, source_text string")
    found = parsing.nodes(files, deep=True)
    got = [(r.name, r.kind, r.visibility, r.declaring_type, r.unit_name) for r in parsing.symbols(found).where("file_id = 1").orderBy("start_line", "start_column").collect()]
    assert got == [
        ("A", "unit", None, None, "A"), ("TEnum", "type", None, None, "A"), ("TBase", "class", None, None, "A"), ("TOuter", "class", None, None, "A"),
        ("TInner", "record", "private", "TOuter", "A"), ("Reset", "method", None, "TInner", "A"), ("Load", "method", "private", "TOuter", "A"),
        ("Size", "property", "published", "TOuter", "A"), ("Name", "method", "published", "TOuter", "A"),
        ("THelp", "helper", None, None, "A"), ("More", "method", None, "THelp", "A"), ("IFoo", "interface", None, None, "A"), ("Run", "method", None, "IFoo", "A"),
    ]
    assert {r.signature for r in parsing.symbols(found).where("name in ('Load', 'Size', 'THelp', 'A')").collect()} == {"unit A;", "procedure Load;", "property Size;", "THelp = helper;"}
    assert [r.name for r in found.where("file_id = 2 and kind = 'class'").collect()] == ["T"] and found.where("file_id = 3").count() == 1


def test_blobs(spark):
    from unitquarry.functions.vectors import from_blob, to_blob

    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    got = df.select(to_blob("v").alias("b")).select("b", from_blob("b").alias("v")).collect()
    assert [r.v for r in got] == [[1.5, -2.0], [], None] and bytes(got[0].b) == b"\x00\x00\xc0?\x00\x00\x00\xc0"


def test_the_query_for_resuming_has_no_cap(spark, tmp_path):
    from unitquarry.plans.source_queries import index_resume

    text = "unit U;\n\ninterface\n\nimplementation\n\n" + "\n\n".join(f"procedure TLong.Number{i};\nbegin\n  Call(Something, {i});\nend;" for i in range(700)) + "\n\nend.\n"
    spark.createDataFrame([(1, "l", "1", "U.pas", text), (2, "m", "1", "U.pas", text)], "file_id long, library string, version string, file_path string, source_text string").write.parquet(f"{tmp_path}/source_files.parquet")
    spark.range(550).selectExpr("id", "'l' AS library", "'1' AS version").write.parquet(f"{tmp_path}/chunks.parquet")
    rows = index_resume(spark, str(tmp_path)).collect()
    assert sorted(r.place for r in rows if r.library == "l") == list(range(551, 702))
    assert sorted(r.place for r in rows if r.library == "m") == list(range(1, 702))
