"""Queries on source text: lines, headers, chunks, tokens, structure; with their SQL where SQL can say it."""

from pyspark.sql import functions as F

from unitquarry.functions import text as T
from unitquarry.operators import chunker, parsing
from unitquarry.plans.source_sql import ORACLE  # noqa: F401
from unitquarry.sources.tables import spread, table


def _files(spark, d):
    return table(spark, d, "source_files")


def _worked(spark, d):
    """The files, for work in Python."""
    return spread(_files(spark, d))


def _texts(spark, d):
    """Files with their lines as an array, so that what is counted per file needs no exchange."""
    return _files(spark, d).where("source_text is not null").select("file_id", T.lines(F.col("source_text")).alias("l"))


def _lines(spark, d):
    return _texts(spark, d).select("file_id", F.posexplode("l").alias("line", "text"))


def src_lines(spark, d):
    blank = F.size(F.filter("l", lambda x: T.trim_all(x) == ""))
    return _texts(spark, d).select("file_id", F.size("l").cast("bigint").alias("lines"), blank.cast("bigint").alias("blank"))


def chunk_header(spark, d):
    f = _files(spark, d).where("source_text is not null")
    return f.select("file_id", T.unit_name(F.col("file_path")).alias("unit_name"), F.array_join(F.slice(T.lines(F.col("source_text")), 1, 30), "\n").alias("content"))


def unit_names(spark, d):
    return _files(spark, d).select("file_id", T.unit_name(F.col("file_path")).alias("unit_name"))


def strip_line(spark, d):
    """Of each file, the characters that are left when strings and comments within lines are taken out, and the lines that change."""
    total = F.aggregate("l", F.lit(0).cast("bigint"), lambda n, x: n + F.length(T.without_noise(x)))
    return _texts(spark, d).select("file_id", total.alias("left"), F.size(F.filter("l", lambda x: T.without_noise(x) != x)).cast("bigint").alias("changed"))


def kw_counts(spark, d):
    plain = _texts(spark, d).select("file_id", F.array_join(F.transform("l", T.without_noise), "\n").alias("text"))
    count = lambda w: F.size(F.regexp_extract_all("text", F.lit(rf"(?i)\b{w}\b"), F.lit(0))).cast("bigint")
    return plain.select("file_id", count("begin").alias("begins"), count("end").alias("ends"))


def section_track(spark, d):
    """Lines of each file by the section they are in, as the last section line before them says."""
    start = F.struct(F.lit("interface").alias("section"), F.lit(0).cast("bigint").alias("interface"), F.lit(0).cast("bigint").alias("implementation"))

    def step(s, x):
        word = F.lower(T.trim_all(x))
        now = F.when(word.isin("interface", "implementation"), word).otherwise(s["section"])
        one = lambda name: (s[name] + F.when(now == name, 1).otherwise(0)).alias(name)
        return F.struct(now.alias("section"), one("interface"), one("implementation"))

    per = _texts(spark, d).select("file_id", F.aggregate("l", start, step).alias("s"))
    both = F.explode(F.array(*(F.struct(F.lit(x).alias("section"), F.col(f"s.{x}").alias("lines")) for x in ("interface", "implementation")))).alias("b")
    return per.select("file_id", both).where("b.lines > 0").select("file_id", "b.section", "b.lines")


def _headers(spark, d, header):
    found = _lines(spark, d).select("file_id", F.col("line").cast("bigint").alias("line"), header(F.col("text")).alias("h")).where("h is not null")
    return found.select("file_id", "line", "h.identifier", "h.kind")


def type_headers(spark, d):
    return _headers(spark, d, T.type_header)


def routine_headers(spark, d):
    return _headers(spark, d, T.routine_header)


def visibility_parse(spark, d):
    shown = F.explode(F.filter(F.transform("l", T.visibility_of), lambda x: x.isNotNull())).alias("visibility")
    return _texts(spark, d).select("file_id", shown).groupBy("file_id", "visibility").agg(F.count(F.lit(1)).alias("lines"))


def str_trim(spark, d):
    f = _files(spark, d).where("source_text is not null")
    return f.select("file_id", F.length(T.trim_all(F.col("source_text"))).cast("bigint").alias("size"))


def chunk_types(spark, d):
    return chunker.chunk_files(_worked(spark, d)).where("chunk_type = 'type'")


def chunk_routines(spark, d):
    return chunker.chunk_files(_worked(spark, d)).where("chunk_type = 'routine'")


def index_resume(spark, d):
    """The chunks of the source files that a store still lacks which holds as many of a scope as the given one does."""
    have = table(spark, d, "chunks").groupBy("library", "version").agg(F.count(F.lit(1)).alias("chunks"))
    placed = chunker.ordinals(chunker.chunk_files(_worked(spark, d)))
    return chunker.to_index(placed, have).select("file_id", "ordinal", "place", "library", "version", "identifier")


def lex_kinds(spark, d):
    return parsing.token_kinds(_worked(spark, d))


def _marks(files):
    return parsing.regions(parsing.directives(parsing.tokens(files, only=("directive",))))


def directive_regions(spark, d):
    return _marks(_worked(spark, d))[0]


def directive_diagnostics(spark, d):
    """What is said of the files if a third of them ends with an end too many, and a third with a start."""
    more = F.when(F.col("file_id") % 3 == 1, F.lit("\n{$ENDIF}")).when(F.col("file_id") % 3 == 2, F.lit("\n{$IFDEF OPEN}")).otherwise(F.lit(""))
    return _marks(_worked(spark, d).withColumn("source_text", F.concat("source_text", more)))[1]


def unit_structure(spark, d):
    return parsing.nodes(_worked(spark, d)).drop("visibility")


def unit_report(spark, d):
    return parsing.unit_report(_worked(spark, d))


def declaring_type(spark, d):
    """Of each member of a type the type that declares it, null for what no type declares."""
    return parsing.declaring_types(parsing.nodes(_worked(spark, d), deep=True))


def symbol_signature(spark, d):
    return parsing.symbols(parsing.nodes(_worked(spark, d)))


def symbol_members(spark, d):
    return parsing.symbols(parsing.nodes(_worked(spark, d), deep=True))


def parse_result(spark, d):
    """What a parse gives of each file, as text: nodes with their parents, signatures, codes, whether something was cut."""
    r = parsing.parse_results(_worked(spark, d), most_nodes=12, most_symbols=3)
    node = lambda n: F.concat_ws(" ", n["id"], F.coalesce(n["parent_id"], F.lit("-")), n["kind"], n["name"])
    joined = lambda c, f, name: F.array_join(F.transform(c, f), "|").alias(name)
    return r.select("file_id", "unit_name", joined("nodes", node, "nodes"), joined("symbols", lambda x: x["signature"], "symbols"), joined("diagnostics", lambda x: x["code"], "codes"), "nodes_truncated", "symbols_truncated")


def uses_units(spark, d):
    return parsing.used_units(parsing.nodes(_worked(spark, d)))


def normal_form(spark, d):
    """A fingerprint of each file's normal form, with which files that differ in blanks only agree."""
    return parsing.normalized(_worked(spark, d)).select("file_id", F.md5("text").alias("md5"), F.length("text").cast("bigint").alias("size"))


QUERIES = {
    f.__name__: f
    for f in (
        src_lines, chunk_header, unit_names, strip_line, kw_counts, section_track, type_headers, routine_headers, visibility_parse, str_trim,
        chunk_types, chunk_routines, index_resume, lex_kinds, directive_regions, directive_diagnostics, unit_structure, unit_report, declaring_type, symbol_signature, symbol_members, parse_result, uses_units, normal_form,
    )
}
