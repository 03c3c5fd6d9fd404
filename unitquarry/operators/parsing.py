"""Tokens, conditional regions, unit structure, symbols and normal form of Pascal source.

The scanner is one pattern; what follows from the tokens is worked out on the token table where order within a file can be
stated by windows, and in small functions per file where it can't."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_TOKEN = re.compile(
    r"(?P<whitespace>\s+)|(?P<directive>\{\$[^}]*\}?|\((?=\*\$).*?(?:\*\)|\Z))|(?P<comment>\{[^}]*\}?|\((?=\*).*?(?:\*\)|\Z)|//[^\n]*)|(?P<string>'(?:''|[^'])*'?)|(?P<identifier>[^\W\d]\w*)|(?P<number>\d[\d.]*)|(?P<symbol>.)",
    re.S,
)
# The words that the grammar knows.
REGION_STARTS, REGION_ENDS = ("IFDEF", "IFNDEF", "IF", "IFOPT"), ("ENDIF", "IFEND")
SECTIONS = ("interface", "implementation", "initialization", "finalization")
LEAVES_TYPES = frozenset("const var procedure function class constructor destructor implementation initialization finalization begin".split())
BREAKS_BEFORE = frozenset("unit interface implementation initialization finalization type var const".split())
#: Kinds of nodes that are symbols, and what they are called as such; those that can declare others.
SYMBOL_KINDS = {"type": "type", "class": "class", "record": "record", "interface_type": "interface", "helper": "helper", "method": "method", "property": "property"}
DECLARING = ("class", "record", "interface_type", "helper")
SHOWN = ("private", "protected", "public", "published")
ROUTINES = ("procedure", "function", "constructor", "destructor", "operator")

TOKENS = "file_id bigint, pos int, kind string, text string, start_line int, start_column int, end_line int, end_column int"
NODES = "file_id bigint, id string, parent_id string, kind string, name string, start_line int, start_column int, end_line int, end_column int, visibility string"


def scan(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of all tokens; together they are the text."""
    return [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(text)]


class _Places:
    """Line and column, from 1, of an offset."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def __call__(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1


def _per_file(files: DataFrame, rows_of, schema: str, text: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(f, *r) for f, t in pdf.itertuples(index=False) for r in rows_of(t)], columns=names)

    return files.where(F.col(text).isNotNull()).select("file_id", text).mapInPandas(run, schema)


def tokens(files: DataFrame, *, text: str = "source_text", only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per token of each file, of the kinds in ``only`` if given; null and empty texts have none."""
    names = [c.strip().split(" ")[0] for c in TOKENS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds, texts, parts = [], [], []
            for file_id, t in pdf.itertuples(index=False):
                found = scan(t)
                begin = np.array([o for _, _, o in found], np.int64)
                end = np.append(begin[1:], len(t))
                keep = [i for i, (k, _, _) in enumerate(found) if only is None or k in only]
                starts = np.array([0, *[m.end() for m in re.finditer("\n", t)]], np.int64)
                first, last = (np.searchsorted(starts, o, "right") for o in (begin[keep], end[keep]))
                kinds += [found[i][0] for i in keep]
                texts += [found[i][1] for i in keep]
                parts.append(np.array([np.full(len(keep), file_id), keep, first, begin[keep] - starts[first - 1] + 1, last, end[keep] - starts[last - 1] + 1], np.int64))
            if kinds:
                n = np.concatenate(parts, 1)
                yield pd.DataFrame(dict(zip(names, [n[0], n[1], kinds, texts, *n[2:]])))

    return files.where(F.col(text).isNotNull() & (F.col(text) != "")).select("file_id", text).mapInPandas(run, TOKENS)


def token_kinds(files: DataFrame, *, text: str = "source_text") -> DataFrame:
    """``file_id, kind, tokens, chars``: how many tokens of each kind a file has, counted where it is read."""

    def count(t: str) -> list[tuple]:
        per: dict[str, list[int]] = {}
        for kind, x, _ in scan(t):
            n = per.setdefault(kind, [0, 0])
            n[0] += 1
            n[1] += len(x)
        return [(k, *n) for k, n in per.items()]

    return _per_file(files, count, "file_id bigint, kind string, tokens bigint, chars bigint", text)


def directives(found: DataFrame) -> DataFrame:
    """Directive tokens as ``file_id, pos, directive, condition`` and their places; the frame is taken off closed ones, words are split at the first blank."""
    trimmed = F.trim("text")
    inner = F.when(trimmed.rlike(r"(?s)^\{\$.*\}$"), F.expr("substring(trim(text), 3, length(trim(text)) - 3)")).when(trimmed.rlike(r"(?s)^\(\*\$.*\*\)$"), F.expr("substring(trim(text), 4, length(trim(text)) - 5)")).otherwise(trimmed)
    plain = F.regexp_replace(inner, r"^\s+|\s+$", "")
    rest = F.regexp_replace(F.regexp_extract(plain, r"(?s)^[^ ]+ +(.*)$", 1), r"^\s+|\s+$", "")
    return found.where("kind = 'directive'").withColumn("_p", plain).where("_p <> ''").select(
        "file_id", "pos", F.upper(F.substring_index("_p", " ", 1)).alias("directive"), F.when(rest != "", rest).alias("condition"), "start_line", "start_column", "end_line", "end_column"
    )


def regions(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(closed regions, diagnostics) of directives: DP2001 for an end without a start, DP2002 for a start without an end.

    The depth is a running sum that starts anew at each unmatched end; at one depth, starts and their ends take turns."""
    step = marks.where(F.col("directive").isin(*REGION_STARTS, *REGION_ENDS)).withColumn("_d", F.when(F.col("directive").isin(*REGION_STARTS), 1).otherwise(-1))
    line = Window.partitionBy("file_id").orderBy("pos")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    summed = step.withColumn("_s", F.sum("_d").over(so_far))
    low = F.least(F.lit(0), F.min("_s").over(so_far))
    lowest = summed.withColumn("_low", low).withColumn("_was", F.coalesce(F.lag("_low").over(line), F.lit(0)))
    unmatched = (F.col("_d") == -1) & (F.col("_low") < F.col("_was"))
    place = ["start_line", "start_column", "end_line", "end_column"]
    stray = lowest.where(unmatched).select("file_id", F.lit("DP2001").alias("code"), "directive", *place)
    level = F.col("_s") - F.col("_low") + F.when(F.col("_d") == -1, 1).otherwise(0)
    turn = Window.partitionBy("file_id", "_level").orderBy("pos")
    kept = lowest.where(~unmatched).withColumn("_level", level)
    follows = kept.withColumns({"_to": F.lead("directive").over(turn), "_end": F.lead("pos").over(turn), "_line": F.lead("end_line").over(turn), "_column": F.lead("end_column").over(turn)}).where("_d = 1")
    closed = follows.where("_to is not null").select("file_id", "directive", "condition", "start_line", "start_column", F.col("_line").alias("end_line"), F.col("_column").alias("end_column"), F.col("_level").cast("int").alias("depth"))
    open_ = follows.where("_to is null").select("file_id", F.lit("DP2002").alias("code"), "directive", *place)
    return closed, stray.unionAll(open_)


def unit_nodes(text: str, deep: bool = False) -> list[tuple]:
    """(id, parent_id, kind, name, four places, visibility) of a unit: the unit, its sections, used units and types, in order.

    With ``deep``, the types' own members as well: methods, properties and nested types, which don't end the block of types."""
    found = [(k, x, o) for k, x, o in scan(text) if k in ("identifier", "symbol", "string", "number")]
    at = _Places(text)
    word = [x.lower() if k == "identifier" else "" for k, x, _ in found]
    span = lambda i, j: (*at(found[i][2]), *at(found[j][2] + len(found[j][1])))
    name = next((found[i + 1][1] for i in range(len(found) - 1) if word[i] == "unit" and word[i + 1]), None)
    nodes: list[tuple] = [("n1", None, "unit", name or "<unknown-unit>", *(span(0, len(found) - 1) if found else (0, 0, 0, 0)), None)]
    section_ids: dict[str, str] = {}
    section, types, i = None, False, 0

    def add(parent: str, kind: str, label: str, place: tuple, visibility: str | None = None) -> str:
        nodes.append((f"n{len(nodes) + 1}", parent, kind, label, *place, visibility))
        return nodes[-1][0]

    def declares(i: int) -> str | None:
        """The kind of the type declared at token ``i``, if one is."""
        if not word[i] or i + 2 >= len(found) or found[i + 1][:2] != ("symbol", "="):
            return None
        kind = word[i + 2]
        if deep and kind == "packed" and i + 3 < len(found):
            kind = word[i + 3]
        if deep and i + 3 < len(found) and kind in ("class", "record") and word[i + 3] == "helper":
            return "helper"
        return {"class": "class", "record": "record", "interface": "interface_type"}.get(kind)

    def members(owner: str, i: int) -> int:
        """Adds the members of the type whose name is token ``i``; the token that ends its body, or that its name ends with."""
        j, n = i + 3 + (word[i + 2] == "packed"), len(found)
        while j < n and word[j] in ("helper", "sealed", "abstract"):
            j += 1
        while j < n and (word[j] == "for" or word[j - 1] == "for" or found[j][1] == "." or found[j - 1][1] == "." and word[j]):
            j += 1
        if j < n and found[j][1] == "(":
            j = next((m for m in range(j, n) if found[m][1] == ")"), n) + 1
        if j >= n or found[j][1] == ";" or word[j] == "of":
            return min(j, n - 1)
        open_ = 0
        shown, level = None, 0
        while j < len(found):
            w = word[j]
            if found[j][0] == "symbol":
                open_ += {"(": 1, ")": -1}.get(found[j][1], 0)
            elif open_:
                pass
            elif w == "end":
                if not level:
                    return j
                level -= 1
            elif w == "record" and not declares(j - 2):
                level += 1
            elif not level and w in SHOWN and found[j + 1 : j + 2] and found[j + 1][1] not in (":", "=", ","):
                shown = found[j][1]
            elif not level and w in (*ROUTINES, "property") and j + 1 < len(found) and word[j + 1]:
                add(owner, "property" if w == "property" else "method", found[j + 1][1], span(j, j + 1), shown)
                j += 1
            elif not level and (kind := declares(j)):
                inner = add(owner, kind, found[j][1], span(j, j + 2), shown)
                j = members(inner, j)
            j += 1
        return len(found) - 1

    while i < len(found):
        w = word[i]
        if w in SECTIONS:
            section, types = w, False
            if w not in section_ids:
                section_ids[w] = add("n1", f"{w}_section", w, span(i, i))
        elif w == "type":
            types = True
        elif w == "uses" and section:
            stop = next((j for j in range(i, len(found)) if found[j][1] == ";" and found[j][0] == "symbol"), None)
            entry: list[str] = []
            skip = False
            for j in range(i + 1, len(found) if stop is None else stop + 1):
                kind, x, _ = found[j]
                if kind == "symbol" and x in ",;":
                    used = "".join(entry).strip(".")
                    if used.strip():
                        add(section_ids[section], "uses", used, (0, 0, 0, 0))
                    entry, skip = [], False
                elif word[j] == "in":
                    skip = True
                elif not skip and (kind == "identifier" or x == "." and kind == "symbol"):
                    entry.append(x)
            i = len(found) if stop is None else stop
        elif types and w in LEAVES_TYPES:
            types = False
        elif types and (kind := declares(i)):
            owner = add(section_ids.get(section, "n1"), kind, found[i][1], span(i, i + 2))
            i = members(owner, i) if deep else i + 2
        elif deep and types and w and found[i + 1 : i + 2] and found[i + 1][:2] == ("symbol", "="):
            add(section_ids.get(section, "n1"), "type", found[i][1], span(i, i + 1))
        i += 1
    return nodes


def nodes(files: DataFrame, *, text: str = "source_text", deep: bool = False) -> DataFrame:
    return _per_file(files, lambda t: unit_nodes(t, deep), NODES, text)


def declaring_types(found: DataFrame) -> DataFrame:
    """``file_id, id, declaring_type``: of each node the nearest type above it, null if there is none.  Parents may be missing;
    a file with two nodes of one id raises an error.

    A file's nodes come from one text, so that they are put together in one task."""
    kind = found.schema["file_id"].dataType.simpleString()

    def climb(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["id"].duplicated().any():
            raise ValueError(f"file {pdf['file_id'].iloc[0]} has two nodes of one id")
        up, own = dict(zip(pdf["id"], pdf["parent_id"])), {i: n for i, n, k in zip(pdf["id"], pdf["name"], pdf["kind"]) if k in DECLARING}
        known: dict = {}
        for start in pdf["id"]:
            path, at = [], start
            while at in up and at not in known:
                path.append(at)
                at = up[at]
            for child in reversed(path):
                known[child] = own.get(up[child]) if up[child] in own else known.get(up[child])
        return pd.DataFrame({"file_id": pdf["file_id"], "id": pdf["id"], "declaring_type": [known[i] for i in pdf["id"]]})

    return found.groupBy("file_id").applyInPandas(climb, f"file_id {kind}, id string, declaring_type string")


def symbols(found: DataFrame) -> DataFrame:
    """``file_id, unit_name, name, kind, signature, visibility, declaring_type`` and the place of the units that have a name, and of the
    types and members among the nodes; a unit has no place of its own."""
    kinds = F.create_map(*[F.lit(x) for kv in SYMBOL_KINDS.items() for x in kv])
    kind, none = kinds[F.col("kind")], F.lit(None).cast("string")
    place = ["start_line", "start_column", "end_line", "end_column"]
    units = found.where("kind = 'unit'").select("file_id", F.nullif("name", F.lit("<unknown-unit>")).alias("unit_name"))
    own = units.where("unit_name is not null").select("file_id", "unit_name", F.col("unit_name").alias("name"), F.lit("unit").alias("kind"), F.concat(F.lit("unit "), "unit_name", F.lit(";")).alias("signature"), none.alias("visibility"), none.alias("declaring_type"), *(F.lit(0).alias(c) for c in place))
    signature = F.when(F.col("kind") == "method", F.concat(F.lit("procedure "), "name", F.lit(";"))).when(F.col("kind") == "property", F.concat(F.lit("property "), "name", F.lit(";"))).otherwise(F.concat("name", F.lit(" = "), kind, F.lit(";")))
    each = found.where(F.col("kind").isin(*SYMBOL_KINDS)).join(declaring_types(found.select("file_id", "id", "parent_id", "kind", "name")), ["file_id", "id"]).join(units, "file_id")
    return own.unionAll(each.select("file_id", "unit_name", "name", kind.alias("kind"), signature.alias("signature"), "visibility", "declaring_type", *place))


def used_units(found: DataFrame) -> DataFrame:
    """``file_id, section, unit, pos``: each used unit of a section once, in any case, under its first spelling."""
    sections = found.where(F.col("kind").endswith("_section")).select("file_id", F.col("id").alias("parent_id"), F.col("name").alias("section"))
    number = F.substring("id", 2, 10).cast("int")
    uses = found.where("kind = 'uses'").join(sections, ["file_id", "parent_id"]).groupBy("file_id", "section", F.lower("name").alias("_u")).agg(F.min(F.struct(number.alias("pos"), F.col("name").alias("unit"))).alias("_m"))
    return uses.select("file_id", "section", F.col("_m.unit").alias("unit"), F.col("_m.pos").alias("pos"))


def normal_form(text: str, comments: bool = True) -> str:
    """The text with uniform blanks and line breaks.

    What stands between two neighbours is a rule on the two: a new line around directives, behind semicolons and before
    the words that begin a part; else a blank, but none before symbols, nor behind symbols other than closing brackets.  A comma
    has a blank behind it, whatever follows.  A comment that is left out still counts as a neighbour."""
    tokens = [(k, x.strip() if k in ("directive", "comment") else x) for k, x, _ in scan(text) if k != "whitespace"]
    out: list[str] = []
    fresh = True
    for (before, b), (kind, x) in zip([("", ""), *tokens], tokens):
        breaks = kind == "directive" or before == "directive" or (kind == "identifier" and x.lower() in BREAKS_BEFORE) or (before, b) == ("symbol", ";")
        fresh = fresh or breaks
        if breaks and out and out[-1] != "\n":
            out.append("\n")
        if kind == "comment" and not comments:
            continue
        apart = kind == "comment" or kind != "symbol" and (before != "symbol" or b in ")]")
        out.append(x if fresh or not apart else " " + x)
        fresh = False
        if (kind, x) == ("symbol", ","):
            out.append(" ")
    return "".join(out).replace("\r\n", "\n").rstrip("\n \t")


def normalized(files: DataFrame, *, text: str = "source_text", comments: bool = True) -> DataFrame:
    """``file_id, text`` in normal form; null texts have no row."""
    return _per_file(files, lambda t: [(normal_form(t, comments),)], "file_id bigint, text string", text)


#: What a report gives of a file, at most.
MOST_NODES, MOST_SYMBOLS = 5000, 2000


def unit_report(files: DataFrame, *, text: str = "source_text", most_nodes: int = MOST_NODES, most_symbols: int = MOST_SYMBOLS) -> DataFrame:
    """One row per file with a text: its unit name (null if it has none, which is DP3001), how many nodes, sections, uses,
    types and symbols it has, how many of them a report gives, and whether it cuts them."""
    found = nodes(files, text=text)
    is_ = lambda *k: F.count_if(F.col("kind").isin(*k))
    per = found.groupBy("file_id").agg(
        F.nullif(F.max(F.when(F.col("kind") == "unit", F.col("name"))), F.lit("<unknown-unit>")).alias("unit_name"),
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("kind").endswith("_section")).alias("sections"),
        is_("uses").alias("uses"),
        is_(*SYMBOL_KINDS).alias("types"),
    )
    symbols_ = F.col("types") + F.col("unit_name").isNotNull().cast("bigint")
    return per.withColumn("symbols", symbols_).withColumns(
        {
            "returned_nodes": F.least("nodes", F.lit(most_nodes).cast("bigint")),
            "returned_symbols": F.least("symbols", F.lit(most_symbols).cast("bigint")),
            "truncated": (F.col("nodes") > most_nodes) | (F.col("symbols") > most_symbols),
            "code": F.when(F.col("unit_name").isNull(), F.lit("DP3001")),
        }
    )


def parse_results(files: DataFrame, *, text: str = "source_text", most_nodes: int = MOST_NODES, most_symbols: int = MOST_SYMBOLS) -> DataFrame:
    """``file_id, unit_name, nodes, symbols, diagnostics, nodes_truncated, symbols_truncated``: one row per file with a text, its parts as arrays of
    structs in the order of the text, cut to what a report may give; kinds and severities are text."""
    place = ["start_line", "start_column", "end_line", "end_column"]
    each = F.struct(F.substring("id", 2, 10).cast("int").alias("number"), "id", "parent_id", "kind", "name", *place)
    per = nodes(files, text=text).groupBy("file_id").agg(F.array_sort(F.collect_list(each)).alias("all"))
    per = per.withColumn("unit_name", F.nullif(F.col("all")[0]["name"], F.lit("<unknown-unit>")))
    kinds = F.create_map(*[F.lit(x) for kv in SYMBOL_KINDS.items() for x in kv])
    symbol = lambda n: F.struct(n["name"].alias("name"), kinds[n["kind"]].alias("kind"), F.concat(n["name"], F.lit(" = "), kinds[n["kind"]], F.lit(";")).alias("signature"))
    unit = F.struct(F.col("unit_name").alias("name"), F.lit("unit").alias("kind"), F.concat(F.lit("unit "), "unit_name", F.lit(";")).alias("signature"))
    types = F.transform(F.filter("all", lambda n: n["kind"].isin(*SYMBOL_KINDS)), symbol)
    per = per.withColumn("every", F.when(F.col("unit_name").isNull(), types).otherwise(F.concat(F.array(unit), types)))
    missing = F.array(F.struct(F.lit("DP3001").alias("code"), F.lit("Warning").alias("severity"), F.lit("No unit name was found.").alias("message")))
    return per.select(
        "file_id",
        "unit_name",
        F.transform(F.slice("all", 1, most_nodes), lambda n: n.dropFields("number")).alias("nodes"),
        F.slice("every", 1, most_symbols).alias("symbols"),
        F.when(F.col("unit_name").isNull(), missing).otherwise(F.slice(missing, 1, 0)).alias("diagnostics"),
        (F.size("all") > most_nodes).alias("nodes_truncated"),
        (F.size("every") > most_symbols).alias("symbols_truncated"),
    )


def as_json(results: DataFrame) -> DataFrame:
    """``file_id, json``: the rows of ``parse_results`` as text, nulls included."""
    return results.select("file_id", F.to_json(F.struct(*[c for c in results.columns if c != "file_id"]), {"ignoreNullFields": "false"}).alias("json"))
