"""Source files that nobody wrote by hand: generated, minified, vendored, or data stored as code.

A grammar in Re-Pair's manner is inferred over the tokens of each file: adjacent pairs that occur again become
rules, rules pair up with their neighbours, and so on.  A file whose kinds of tokens shrink to few symbols, whose rules are
reused much, came out of a tool; literals that a grammar can't shrink make it data; rules that a file shares with a
foreign package's units or with another library make it a copy; comments that go with the files found so tell the
tools' own marks.  Many statements a line, or names that no person chose, make it minified."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitquarry.session import stored
from unitquarry.sources.tables import spread

#: Share of its tokens that are left of a generated file of BASE tokens, at most; larger files repeat themselves more, so the bound falls with the power FALL of the size; tokens that a file must have for that.
SHRUNK, BASE, FALL, TOKENS = 0.24, 300, 0.35, 60
#: Symbols of a grammar below this number are tokens or characters, those from it on are rules.
RULES = 2048
#: Share of what the grammars leave of a file that is left of its literals, such symbols, and share of its characters that are in literals, at least, of a file that is data.
HARD, HARD_LEFT, LITERAL = 0.8, 80, 0.5
#: Statements a line of code in a minified file, and in all, at least; share of its names that look like a machine's, and such names, of an obfuscated file.
DENSE, STATEMENTS, MACHINE, NAMES = 2, 8, 0.25, 8
#: Share of a file's tokens in rules of one foreign package that makes it a copy; rounds of the shared grammar.
COPIED, LEVELS = 0.3, 6
#: Tokens of a rule that counts when libraries share it, at least.
LONG = 8
#: A folder, or a run of words that names one in a file's first comments, tells copies if so many files have it, so many of them found copied, so great a share; turns in which copies found so tell further marks.
ORIGIN_FILES, ORIGIN_FOUND, ORIGIN_SHARE, TURNS = 4, 2, 0.4, 3
#: A comment phrase is a tool's mark if so many files have it, so many of them found generated, so great a share.
MARK_FILES, MARK_FOUND, MARK_SHARE, MARK_WORDS = 4, 2, 0.35, 4

#: A name without a word: one letter and a hexadecimal number behind underscores, letters and a longer number, or only characters that look alike.
_MACHINE = re.compile(r"_+[a-z]?[0-9a-f]*\d[0-9a-f]*|[a-z]{1,2}\d{2,}|[lio01_]{4,}")
_LINE_COMMENT = re.compile(r"^[^\S\n]*//", re.M)
_SEMICOLON = 128 + ord(";")
_TOKEN = re.compile(r"\{[^}]*\}|\(\*.*?\*\)|//[^\n]*|/\*.*?\*/|'[^'\n]*'|\"[^\"\n]*\"|[^\W\d]\w*|[$\d][\w.]*|[^\s\w]", re.S)
#: The words that keep their own symbol; every other name counts as one kind of token.
_KEYWORDS = frozenset(
    "unit interface implementation initialization finalization uses type class record object end begin procedure function constructor destructor operator var const resourcestring property read write default stored private protected public published strict "
    "if then else for to downto do while repeat until try finally except on raise with case of and or not xor in is as nil set array string packed file inherited override virtual abstract overload reintroduce dynamic static stdcall cdecl safecall out goto label asm".split()
)
_BARE = re.compile(_TOKEN.pattern.split("|", 4)[-1], re.S)
_KEYWORD_NUMBER = {w: i for i, w in enumerate(sorted(_KEYWORDS))}


def repair(symbols: np.ndarray, owner: np.ndarray, files: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols left, rules) of each file.  ``owner`` is the file of each symbol, in order; symbols are below ``RULES``.

    In each round, every pair that occurs again in its file and more often than the pairs that overlap it becomes a
    symbol, until no pair does.  All files of a batch go through a round together, but none sees another's pairs, and
    rules are numbered file by file: a file's grammar is the same whatever the batch."""
    sym, own = symbols.astype(np.int64), owner.astype(np.int64)
    left, rules = np.bincount(own, minlength=files).astype(np.int64), np.zeros(files, np.int64)
    while len(sym) > 1:
        same = own[1:] == own[:-1]
        names = int(sym.max()) + 1
        pair, pairs = sym[:-1] * names + sym[1:], names * names
        if pairs * (files + 1) >= 1 << 62:
            pair, pairs = np.unique(pair, return_inverse=True)[1], len(pair)
        _, code, count = np.unique(np.where(same, own[:-1], files) * pairs + pair, return_inverse=True, return_counts=True)
        c = np.where(same, count[code], 0)
        # the more frequent pair goes first; of equally frequent ones the order of their mixed names decides
        mixed = ((sym[:-1] * 7919 + sym[1:]) * 0x9E3779B1) & 0xFFFFF
        rank = (c << 20) + np.where(same, mixed, 0)
        twin = np.concatenate([[False], (code[1:] == code[:-1]) & same[1:]])
        before, after = np.concatenate([[0], rank[:-1]]), np.concatenate([rank[1:], [0]])
        place = np.arange(len(c))
        step = place - np.maximum.accumulate(np.where(twin, 0, place))
        pick = (c >= 2) & ((rank > before) | twin) & ((rank > after) | np.concatenate([twin[1:], [False]])) & (step % 2 == 0)
        at = np.flatnonzero(pick)
        # A pair must still occur twice among those picked, else the rule would save nothing.
        at = at[np.bincount(code[at], minlength=len(count))[code[at]] >= 2]
        if not len(at):
            break
        _, first, number = np.unique(code[at], return_index=True, return_inverse=True)
        new = np.bincount(own[at[first]], minlength=files)
        sym[at] = RULES + (rules - np.cumsum(new) + new)[own[at]] + number
        rules += new
        left -= np.bincount(own[at], minlength=files)
        keep = (new > 0)[own]
        keep[at + 1] = False
        sym, own = sym[keep], own[keep]
    return left, rules


def shared_rules(hashes: np.ndarray, owner: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rule, length, file) of the top rules of a grammar whose rules are the same wherever the same tokens stand.

    Over many repositories every pair of a copy occurs again, so no count tells pairs apart; the order of their
    hashes decides instead, as it is the same everywhere."""
    h, own, size = hashes.copy(), owner, np.ones(len(hashes), np.int64)
    for _ in range(levels):
        if len(h) < 2:
            break
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
        pair ^= pair >> np.uint64(29)
        pair *= np.uint64(0xBF58476D1CE4E5B9)
        pair ^= pair >> np.uint64(32)
        value = np.where(own[1:] == own[:-1], pair, np.uint64(0))
        before, after = np.concatenate([[np.uint64(0)], value[:-1]]), np.concatenate([value[1:], [np.uint64(0)]])
        at = np.flatnonzero((value > before) & (value > after))
        h[at] = pair[at]
        size[at] += size[at + 1]
        keep = np.ones(len(h), bool)
        keep[at + 1] = False
        h, own, size = h[keep], own[keep], size[keep]
    return h, size, own


class _Tokens(dict):
    """Numbers of tokens, and by number: kind (-1 comment, -2 directive), hash of the folded token, whether it is a literal, and whether it is a machine-like name.

    Kinds and hashes don't depend on what came before, so that the table can be emptied when it is large."""

    def __init__(self) -> None:
        self.kind, self.hash, self.literal = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, bool)
        self.machine = np.zeros(1 << 16, bool)

    def __missing__(self, x: str) -> int:
        n = len(self)
        if n == len(self.kind):
            self.kind, self.hash, self.literal, self.machine = (np.concatenate([v, np.zeros_like(v)]) for v in (self.kind, self.hash, self.literal, self.machine))
        c, low, literal, machine = x[0], x.lower(), False, False
        if c in "'\"" and len(x) > 1:
            kind, literal, low = 2, True, x
        elif c.isdigit() or c == "$":
            kind, literal = 1, True
        elif (c == "{" and len(x) > 1) or x[:2] in ("//", "(*", "/*") and len(x) > 1:
            kind = -2 if x[:2] == "{$" else -1
            if c == "{" and len(x) > 64 and re.fullmatch(r"\{[\s0-9A-Fa-f]+\}", x):
                kind, literal = 2, True  # binary data of a form
        elif c.isalpha() or c == "_":
            kind = 3 + _KEYWORD_NUMBER[low] if low in _KEYWORD_NUMBER else 0
            if len(x) >= 32 and re.fullmatch(r"[0-9A-Fa-f]+", x):
                literal = True  # hexadecimal data without any mark
            machine = kind == 0 and not literal and _MACHINE.fullmatch(low) is not None
        else:
            kind = 128 + ord(c) % 1024
        self.kind[n], self.hash[n], self.literal[n] = kind, zlib.crc32(low.encode("utf-8", "replace")) | len(low) << 32, literal
        self.machine[n] = machine
        self[x] = n
        return n


def _phrases(comments: list[str]) -> list[int]:
    """Hashes of the runs of words of a file's comments, in lower case, with numbers and checksums as 0."""
    out = set()
    for c in comments:
        w = [v if v.isalpha() else re.sub(r"\d+|(?=\w*\d)[0-9a-f]{6,}", "0", v) for v in re.findall(r"[^\W_]+|@|<", c.lower())]
        out |= {" ".join(w[i : i + MARK_WORDS]) for i in range(max(1, len(w) - MARK_WORDS + 1))} if w else set()
        if len(w) > 1 and w[0] == "@":
            out.add("@ " + w[1])
    return sorted(xxhash.xxh64_intdigest(p) - (1 << 63) for p in out)


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def _origin(head: list[str], path: str | None, library: str | None) -> list[int]:
    """Hashes of the folders of a file, and of the runs of words of its first comments that name one of the folders.

    The folder's name counts as one word whatever it is, and so does the library's own; numbers count as 0."""
    own = _plain(library or "")
    folders = {f for f in map(_plain, re.split(r"[/\\]+", path or "")[:-1]) if f and f != own}
    out, names = {"/" + f for f in folders}, {f for f in folders if len(f) >= 4 and not f.isdigit()}
    if names:
        for c in head:
            w: list[str] = []
            for v in map(_plain, re.findall(r"\w+", c)):
                v = "<own>" if v == own else "<folder>" if v in names else re.sub(r"\d+", "0", v)
                if v and not (v == "0" and w[-1:] == ["0"]):
                    w.append(v)
            runs = (w[i : i + MARK_WORDS] for i in range(max(1, len(w) - MARK_WORDS + 1)))
            out |= {" ".join(r) for r in runs if "<folder>" in r and len(r) > 1}
    return sorted(xxhash.xxh64_intdigest(p) - (1 << 63) for p in out)


def _features(texts: list[str | None], known: _Tokens | None = None, paths: list[str | None] | None = None, libraries: list[str | None] | None = None) -> dict:
    """Per file of a batch: tokens, symbols left, rules, what is left of the literals, characters in literals and in all, statements, lines of code, names, machine-like names, shared rules, comment phrases, marks of origin."""
    known = _Tokens() if known is None else known
    if len(known) > 500_000:
        known.clear()
    symbols, hashes, lengths, rows, characters = [], [], [], [], []
    for text, path, library in zip(texts, paths or [None] * len(texts), libraries or [None] * len(texts)):
        t = (text or "").lstrip("\ufeff")
        tokens = _TOKEN.findall(t)
        number = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        kind = known.kind[number]
        if tokens and not (kind >= 0).any():
            # a text of another kind, that the frame of a comment happens to hold
            tokens = _BARE.findall(t)
            number = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
            kind = known.kind[number]
        code = number[kind >= 0]
        literals = "".join([tokens[i] for i in np.flatnonzero(known.literal[number])])
        solid = len(t) - sum(map(t.count, " \t\r\n\xa0"))
        # only where literals prevail does it matter what a grammar leaves of them
        characters.append(np.frombuffer(literals.encode("latin-1", "replace") if len(literals) >= LITERAL * solid else b"", np.uint8))
        symbols.append(kind[kind >= 0])
        hashes.append(known.hash[code])
        lengths.append(len(code))
        comments = [tokens[i] for i in np.flatnonzero(kind == -1)]
        first = int(np.argmax(kind >= 0)) if len(code) else len(kind)
        head = [tokens[i] for i in np.flatnonzero(kind[:first] == -1)]
        body = t.strip()
        lines = max(body.count("\n"), body.count("\r")) + 1 - sum(max(c.count("\n"), c.count("\r")) for c in comments) - len(_LINE_COMMENT.findall(body))
        once = np.unique(code)
        once = once[known.kind[once] == 0]
        rows.append((len(literals), solid, int((known.kind[code] == _SEMICOLON).sum()), max(1, lines), len(once), int(known.machine[once].sum()), _phrases(comments), _origin(head, path, library)))
    owner = np.repeat(np.arange(len(texts)), lengths)
    flat = np.concatenate(symbols) if symbols else np.zeros(0, np.int64)
    left, rules = repair(flat, owner, len(texts))
    plain = np.concatenate(characters) if characters else np.zeros(0, np.uint8)
    hard, parts = repair(plain, np.repeat(np.arange(len(texts)), list(map(len, characters))), len(texts))
    h, size, own = shared_rules(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), owner)
    big = size >= 4
    h, size, own = h[big].view(np.int64), size[big], own[big]
    cuts = np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)
    return {
        "tokens": lengths,
        "left": left.tolist(),
        "rules": rules.tolist(),
        "hard": (hard + parts).tolist(),
        **{c: [r[i] for r in rows] for i, c in enumerate(("literals", "solid", "statements", "lines", "names", "machine", "phrases", "origin"))},
        "shared": pa.ListArray.from_arrays(pa.array(cuts), pa.array(h)),
        "sizes": pa.ListArray.from_arrays(pa.array(cuts), pa.array(size.astype(np.int32))),
    }


_NUMBERS = ("tokens", "left", "rules", "hard", "literals", "solid", "statements", "lines", "names", "machine")
_FEATURES = f"id bigint, library string, {' int, '.join(_NUMBERS)} int, phrases array<bigint>, origin array<bigint>, shared array<bigint>, sizes array<int>"


def features(files: DataFrame, *, key: str, text: str, path: str | None = None, library: str | None = None) -> DataFrame:
    """Grammar, shape and origin of each file with a text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for whole in batches:
            for at in range(0, len(whole), 400):
                batch = whole.slice(at, 400)
                f = _features(batch.column(1).to_pylist(), known, batch.column(2).to_pylist(), batch.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(3).cast(pa.string()),
                        *[pa.array(f[c], pa.int32()) for c in _NUMBERS],
                        *[pa.array(f[c], pa.list_(pa.int64())) for c in ("phrases", "origin")],
                        f["shared"],
                        f["sizes"],
                    ],
                    ["id", "library", *_NUMBERS, "phrases", "origin", "shared", "sizes"],
                )

    given = [F.col(c).cast("string") if c in files.columns else F.lit(None).cast("string") for c in (path, library)]
    rows = files.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), given[0].alias("path"), F.lower(F.trim(given[1])).alias("library"))
    return rows.where(F.col("text").isNotNull() & F.col("id").isNotNull()).mapInArrow(read, _FEATURES)


def _copies(each: DataFrame, foreign: DataFrame) -> DataFrame:
    """``id`` of the files with rules ``id, tokens, rule, size`` that have enough of their tokens in rules of one of the packages of ``foreign`` (``rule, package``, distinct).

    However many packages share a rule, it counts for each of them.  Rules that the same packages have are one set; where
    a file has enough in one set, packages needn't be told apart.  Else the sets that most packages have, so many of them that
    they aren't enough together, can't make a copy alone: only packages that have one of the file's other sets are met, and
    the widespread ones are counted for these."""
    enough = F.lit(COPIED) * F.col("tokens")
    sets = foreign.groupBy("rule").agg(F.count(F.lit(1)).alias("packages"), F.xxhash64(F.count(F.lit(1)), F.bit_xor("package"), F.bit_xor(F.xxhash64("package"))).alias("set"))
    members = sets.groupBy("set").agg(F.min("rule").alias("rule")).join(foreign, "rule").select("set", "package")
    whole = Window.partitionBy("id", "tokens")
    so_far = whole.orderBy(F.col("packages").desc(), "set").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = each.join(sets, "rule").groupBy("id", "tokens", "set", "packages").agg(F.sum("size").alias("size"))
    met = met.select("id", "tokens", "set", "size", F.sum("size").over(whole).alias("all"), F.max("size").over(whole).alias("most"), F.sum("size").over(so_far).alias("so_far"))
    met = stored(met.where(F.col("all") >= enough))
    unsure = met.where(F.col("most") < enough)
    rare = unsure.where(F.col("so_far") >= enough).join(members, "set").groupBy("id", "tokens", "package").agg(F.sum("size").alias("size"))
    common = unsure.where(F.col("so_far") < enough).select("id", "tokens", "set", F.col("size").alias("more"))
    both = rare.join(common, ["id", "tokens"]).join(members, ["set", "package"]).groupBy("id", "tokens", "package").agg((F.first("size") + F.sum("more")).alias("size"))
    return met.where(F.col("most") >= enough).select("id").unionByName(rare.unionByName(both).where(F.col("size") >= enough).select("id"))


def _by_origin(files: DataFrame) -> DataFrame:
    """``id, vendored`` (true) of ``id, library, origin, vendored`` whose flag is set or whose marks of origin go with the flag.

    A mark must go with it in more than one library, so that no library's own tree counts.  What is found in one turn
    tells marks in the next; lineage is cut after each, as a turn uses the one before twice."""
    now = stored(files)
    for _ in range(TURNS):
        hit = F.col("vendored")
        by = now.select("library", "vendored", F.explode("origin").alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hit"), F.min(F.when(hit, F.col("library"))).alias("lo"), F.max(F.when(hit, F.col("library"))).alias("hi"))
        marks = by.where((F.col("n") >= ORIGIN_FILES) & (F.col("hit") >= ORIGIN_FOUND) & (F.col("hit") >= F.lit(ORIGIN_SHARE) * F.col("n")) & (F.col("lo") < F.col("hi"))).select("mark")
        new = now.where(~hit).select("id", F.explode("origin").alias("mark")).join(marks, "mark").select("id").distinct().withColumn("_new", F.lit(True))
        now = stored(now.join(new, "id", "left").select("id", "library", "origin", (hit | F.col("_new").isNotNull()).alias("vendored")))
    return now.where("vendored").select("id", "vendored").distinct()


def not_handwritten(files: DataFrame, upstream: DataFrame, *, key: str = "file_id", text: str = "source_text", package: str = "package", path: str = "file_path", library: str = "library") -> DataFrame:
    """``key, reason`` (generated, minified, data, vendored, marked) of the files that nobody wrote by hand; the first reason that holds.

    Null texts and null keys have no rows, nor have empty and blank texts.  Of rows that repeat a key, the key comes out once
    if any of them is found.  ``upstream`` has the foreign packages' units; null texts there are ignored.  ``files`` may
    lack ``path`` and ``library``; other columns are ignored; an empty table gives an empty result.

    Plan: one pass over the texts, which are not sent; rules of files and of packages, each once whatever the number of packages
    that have it, meet in an equi-join of which Spark sends the packages' side to all tasks if it is small; libraries' rules are counted per rule and met again by
    an equi-join; comment phrases, folders and first comments are counted over all files before anything is sent for
    them."""
    found = stored(features(files, key=key, text=text, path=path, library=library))
    shrunk = (F.col("tokens") >= TOKENS) & (F.col("left") + F.col("rules") < F.least(F.lit(1.4 * SHRUNK), F.lit(SHRUNK) * F.pow(F.lit(float(BASE)) / F.col("tokens"), F.lit(FALL))) * F.col("tokens"))
    dense = (F.col("statements") >= STATEMENTS) & (F.col("statements") >= F.lit(DENSE) * F.col("lines"))
    minified = dense | ((F.col("machine") >= NAMES) & (F.col("machine") >= F.lit(MACHINE) * F.col("names")))
    foreign = stored(features(upstream.withColumn("_u", F.xxhash64(package)), key="_u", text=text).select(F.col("id").alias("package"), F.explode("shared").alias("rule")).distinct())
    each = found.select("id", "tokens", F.explode(F.arrays_zip("shared", "sizes")).alias("r")).select("id", "tokens", F.col("r.shared").alias("rule"), F.col("r.sizes").alias("size"))
    known = _copies(each, foreign)
    long = found.where("library <> ''").select("id", "tokens", F.xxhash64("library").alias("lib"), F.explode(F.arrays_zip("shared", "sizes")).alias("r")).where(F.col("r.sizes") >= LONG).select("id", "tokens", "lib", F.col("r.shared").alias("rule"), F.col("r.sizes").alias("size"))
    wide = long.groupBy("rule").agg(F.min("lib").alias("lo"), F.max("lib").alias("hi")).where("lo <> hi").select("rule")
    alike = long.join(wide, "rule").groupBy("id", "tokens").agg(F.sum("size").alias("size")).where(F.col("size") >= F.lit(COPIED) * F.col("tokens")).select("id")
    copied = known.unionByName(alike).distinct().withColumn("vendored", F.lit(True))
    hard = (F.col("hard") >= HARD_LEFT) & (F.col("hard") >= F.lit(HARD) * (F.col("hard") + F.col("left") + F.col("rules"))) & (F.col("literals") >= F.lit(LITERAL) * F.col("solid"))
    reason = F.when(hard, "data").when(shrunk, "generated").when(minified, "minified")
    vendored = _by_origin(found.where(reason.isNull()).select("id", "library", "origin").join(copied, "id", "left").select("id", "library", "origin", F.coalesce("vendored", F.lit(False)).alias("vendored")))
    plain = found.select("id", "phrases", reason.alias("reason"))
    judged = plain.join(vendored, "id", "left")
    judged = judged.select("id", "phrases", F.when(F.col("reason").isNull() & F.col("vendored"), "vendored").otherwise(F.col("reason")).alias("reason"))
    by_phrase = judged.select("reason", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "generated").alias("hit"), F.count_if(F.col("reason").isNull()).alias("none"))
    marks = by_phrase.where((F.col("n") >= MARK_FILES) & (F.col("hit") >= MARK_FOUND) & (F.col("hit") >= F.lit(MARK_SHARE) * F.col("n"))).select("phrase")
    marked = judged.where("reason is null").select("id", F.explode("phrases").alias("phrase")).join(marks, "phrase").select("id").distinct().withColumn("reason", F.lit("marked"))
    return judged.where("reason is not null").select("id", "reason").unionByName(marked).groupBy("id").agg(F.min("reason").alias("reason")).toDF(key, "reason")


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(spread(spark.read.parquet(f"{d}/source_files.parquet")), spark.read.parquet(f"{d}/upstream_units.parquet"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_files(spark, d).select("file_id")


QUERIES = {"p5_found": p5_found, "p5_files": p5_files}
ORACLE: dict[str, str] = {}
