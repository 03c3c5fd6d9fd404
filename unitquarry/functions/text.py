"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word consists of, spelled out so that Java and other engines agree.
WORD = r"[\p{L}\p{N}_]"
# The words that open types and routines and set visibilities, and the blanks that may come before them.
TYPE_KINDS = ("class", "record", "interface", "dispinterface", "object")
ROUTINE_KINDS = ("procedure", "function", "constructor", "destructor")
VISIBILITIES = ("published", "public", "protected", "private", "strict protected", "strict private")
INDENT = 4
#: A string, a brace comment or a line comment inside one line; whichever opens first wins.
NOISE = r"'[^']*('|$)|\{[^}]*(\}|$)|//.*$"


def lines(text: Column) -> Column:
    """The lines of ``text``; a byte order mark and the empty rest behind a final line end don't count, an empty text has none."""
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(plain, r"\n\z", ""), "\n"))


def unit_name(path: Column) -> Column:
    """The file name without its last extension; both kinds of separators count."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{0085}\p{Z}]+|[\s\x{0085}\p{Z}]+$", "")


def without_noise(line: Column) -> Column:
    return F.regexp_replace(line, NOISE, "")


def _indented(line: Column) -> Column:
    """Whether no more than INDENT blanks come before the first word."""
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", "")) <= INDENT


def type_header(line: Column) -> Column:
    """``identifier, kind`` of the type that a line opens: a name, perhaps with parameters in angle brackets, then ``=``, perhaps ``packed``, and a kind; null for other lines."""
    left = F.substring_index(line, "=", 1)
    name = F.regexp_extract(F.regexp_replace(left, r"\s*<[^>]+>\s*$", ""), rf"^\s*({WORD}+)\s*$", 1)
    word = lambda i: F.lower(F.regexp_extract(F.substr(line, F.length(left) + 2), rf"^\s*({WORD}+)\s*({WORD}*)", i))
    kind = F.when(word(1) == "packed", word(2)).otherwise(word(1))
    return F.when(_indented(line) & (name != "") & kind.isin(*TYPE_KINDS), F.struct(name.alias("identifier"), kind.alias("kind")))


def routine_header(line: Column) -> Column:
    """``identifier, kind`` of the routine that a line opens; null for other lines."""
    parts = F.split(F.regexp_replace(line, r"^\s+", ""), r"\s+", 3)
    kind, name = F.lower(F.try_element_at(parts, F.lit(1))), F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), r"^[\p{L}\p{N}_.]+", 0)
    return F.when(_indented(line) & kind.isin(*ROUTINE_KINDS) & (name != ""), F.struct(name.alias("identifier"), kind.alias("kind")))


def visibility_of(line: Column) -> Column:
    """The visibility that a line declares, ``strict`` left out; null for other lines."""
    words = F.lower(F.trim(F.regexp_replace(without_noise(line), r"\s+", " ")))
    return F.when(words.isin(*VISIBILITIES), F.substring_index(words, " ", -1))


def namespace(unit: Column) -> Column:
    """The part before the first dot, the whole name where there is none or it comes first."""
    return F.when(F.instr(unit, ".") > 1, F.substring_index(unit, ".", 1)).otherwise(unit)


def truncated(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def split_list(text: Column) -> Column:
    """Trimmed, non-empty parts between commas."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
