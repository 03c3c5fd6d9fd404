"""Splitting oversized texts at natural boundaries, by ranges, without holding a whole text in one task.

Lengths are UTF-16 code units throughout.  A text is read as byte ranges with a halo on both sides.  Each range is
scanned alone; its boundary table is stitched to its neighbours' (comment state, prefix sums of units and lines);
cuts are chosen inside stretches of ranges that are independent of each other; pieces are cut out by offset."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitquarry.session import stored

LIMIT, OVERLAP = 5000, 200
#: Bytes of a range, bytes of its halo, and ranges of a stretch.  A stretch begins with a cut at the best place of its first range, so that stretches don't wait for each other; it costs one short piece per 4 MB.
RANGE, HALO, STRETCH = 65536, 512, 64
#: Keys that the pieces of one text are spread over.
SALTS = 32
#: How well a text can be cut at a place: between two characters, behind a word, before a line inside a comment, before any line of code, behind a block's end or at a blank line, before a declaration.
HARD, IN_LINE, IN_COMMENT, LINE, PARAGRAPH, DECLARATION = range(6)

_EOL = re.compile(rb"\r\n|\n|\r")
_DECLARATION = re.compile(rb"\s*(?:unit|interface|implementation|initialization|finalization|type|const|var|uses|(?:class\s+)?(?:procedure|function|constructor|destructor|operator|property)|\w+(?:<[^>]*>)?\s*=\s*(?:packed\s+)?(?:class|record|interface|object)|(?:strict\s+)?(?:private|protected|public|published))\b", re.I)
_END = re.compile(rb"\s*(?:end\s*[;.]?|until\b.*)\s*$", re.I)
_OPEN = {0: re.compile(rb"'[^'\r\n]*'?|//[^\r\n]*|(\{)|(\(\*)"), 1: re.compile(rb"\}"), 2: re.compile(rb"\*\)")}
_SOFT = re.compile(rb"[;,)\s](?=\S)")


def utf16_units(text: Column) -> Column:
    """UTF-16 code units of ``text``: its characters, and one more for each beyond the basic plane."""
    return F.length(text) + F.coalesce(F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", "")), F.lit(0))


def _units(data: bytes) -> int:
    """Code units of whole UTF-8 characters: every byte but the continuing ones begins a unit, and those of four bytes begin two."""
    a = np.frombuffer(data, np.uint8)
    return int(((a & 0xC0) != 0x80).sum() + (a >= 0xF0).sum())


def _state_after(line: bytes, state: int) -> int:
    """0 code, 1 inside { }, 2 inside (* *): the state at the end of ``line``."""
    at = 0
    while m := _OPEN[state].search(line, at):
        at = m.end()
        state = 0 if state else 1 if m[1] else 2 if m[2] else 0
    return state


def scan_range(data: bytes, head: int, tail: int) -> dict:
    """The boundary table of one range.  ``head`` and ``tail`` are the bytes of halo before and behind it.

    A range owns the line starts inside it; a character belongs to the range in which it begins.  Classes and the
    state behind the range are given for each of the three states in which the range may begin."""
    size = len(data)
    lo, hi = head, size - tail
    while lo < size and data[lo] & 0xC0 == 0x80:
        lo += 1
    while hi < size and data[hi] & 0xC0 == 0x80:
        hi += 1
    hi = max(lo, hi)
    ends = [m.end() for m in _EOL.finditer(data)]
    starts = [e for e in ends if lo <= e < hi and (e or head)]
    if not head:
        starts = [0, *[s for s in starts if s]] if hi > 0 else []
    a = np.frombuffer(data, np.uint8)[lo:hi]
    cum = np.concatenate([[0], np.cumsum(((a & 0xC0) != 0x80).astype(np.int64) + (a >= 0xF0))])
    states, offsets, classes = [0, 1, 2], [], ([], [], [])

    def soft(p: int, q: int) -> None:
        """Of a long line, the last place in every 256 bytes where a word or statement ends, else one between two characters."""
        last: dict[int, tuple[int, int]] = {}
        for block in range(p // 256 + 1, q // 256 + 1):
            x = block * 256
            while x < q and data[x] & 0xC0 == 0x80:
                x += 1
            if p < x < q and data[x - 1 : x + 1] != b"\r\n":
                last[block] = (x, HARD)
        for m in _SOFT.finditer(data, p, q):
            last[m.end() // 256] = (m.end(), IN_LINE)
        for x, how in sorted(last.values()):
            if lo < x < hi:
                offsets.append(int(cum[x - lo]))
                for k in range(3):
                    classes[k].append(how)

    follow = [*starts[1:], hi] if starts else []
    begin = starts[0] if starts else hi
    if lo < begin:
        states = [_state_after(data[lo:begin], s) for s in states]
        if begin - lo > 512:
            soft(lo, begin)
    ends_all = [0, *ends]
    for s, nxt in zip(starts, follow):
        line = data[s : min(nxt, s + 400)]
        before = data[max((e for e in ends_all[max(0, np.searchsorted(ends_all, s) - 1) :][:1]), default=0) : s]
        plain = DECLARATION if _DECLARATION.match(line) else PARAGRAPH if not line.strip() or _END.match(before.strip(b"\r\n")) or not before.strip() else LINE
        offsets.append(int(cum[s - lo]))
        for k in range(3):
            classes[k].append(plain if states[k] == 0 else IN_COMMENT)
        if nxt - s > 512:
            soft(s, nxt)
        states = [_state_after(data[s:nxt], x) for x in states]
    is_line = set(int(cum[s - lo]) for s in starts)
    return {"units": int(cum[-1]), "lines": len(starts), "after": states, "offsets": offsets, "is_line": [o in is_line for o in offsets], "classes": [*map(list, classes)], "skip": lo - head}


def choose_cuts(bounds: list[tuple[int, int, int]], start: int, prior: int, stop: int, limit: int, overlap: int, line_starts: np.ndarray) -> list[tuple[int, int]]:
    """Pieces (from, to) of a stretch that begins with a piece at ``start`` and ends at ``stop``.

    ``bounds``: (offset, class, is_line) in order.  ``prior``: where the piece before ended, which is ``start`` but for overlap.
    The best class in the second half of the allowed length wins, and of that the last place; a hard cut comes last."""
    offs = np.array([b[0] for b in bounds], np.int64)
    cls = np.array([b[1] for b in bounds], np.int64)
    out, s, done = [], start, prior
    while True:
        if stop - s <= limit:
            out.append((s, stop))
            return out
        i, j = np.searchsorted(offs, max(done, s + limit // 2), "right"), np.searchsorted(offs, s + limit, "right")
        if i == j:
            i = np.searchsorted(offs, done, "right")
        if i < j:
            at = j - 1 - int(np.argmax(cls[i:j][::-1]))
            e = int(offs[at])
        else:
            e = s + limit
        out.append((s, e))
        done = e
        k = np.searchsorted(line_starts, e - overlap, "left")
        ends_whole = np.searchsorted(line_starts, e, "left") < len(line_starts) and line_starts[np.searchsorted(line_starts, e, "left")] == e
        s = int(line_starts[k]) if ends_whole and k < len(line_starts) and line_starts[k] < e else max(s + 1, e - overlap)


def text_ranges(items: DataFrame, key: str, text: str) -> DataFrame:
    """``item, range_no, head, tail, data``: the byte ranges of a text column, cut in the JVM.

    The array of slices is built first and exploded then, so that the text itself isn't copied once per range."""
    raw = F.encode(F.col(text), "UTF-8")
    sizes = items.select(F.col(key).alias("item"), raw.alias("_raw"), F.octet_length(text).alias("_size"))
    slices = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("_size") - 1) / RANGE).cast("int")),
        lambda i: F.struct(
            i.alias("range_no"),
            F.least(i * RANGE, F.lit(HALO)).alias("head"),
            F.greatest(F.lit(0), F.least(F.col("_size") - (i + 1) * RANGE, F.lit(HALO))).alias("tail"),
            F.substring(F.col("_raw"), i * RANGE - F.least(i * RANGE, F.lit(HALO)) + 1, F.lit(RANGE + 2 * HALO) - (F.lit(HALO) - F.least(i * RANGE, F.lit(HALO)))).alias("data"),
        ),
    )
    return sizes.select("item", F.explode(slices).alias("_r")).select("item", "_r.*")


def file_ranges(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The same for files that all executors can open: ``files`` has ``path STRING, size BIGINT``.  No task reads more than a range and its halo at once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, i, size in zip(pdf["path"], pdf["range_no"], pdf["size"]):
                head = min(i * RANGE, HALO)
                tail = max(0, min(size - (i + 1) * RANGE, HALO))
                with open(path, "rb") as f:
                    f.seek(i * RANGE - head)
                    rows.append((path, i, head, tail, f.read(head + min(RANGE, size - i * RANGE) + tail)))
            yield pd.DataFrame(rows, columns=["item", "range_no", "head", "tail", "data"])

    todo = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / RANGE).cast("int"))).alias("range_no"))
    return todo.mapInPandas(read, "item string, range_no int, head int, tail int, data binary")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over as many tasks as a shuffle has; small rows that cost much to work on aren't put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([{"item": x.item, "range_no": x.range_no, "tail": x.tail, **scan_range(x.data, x.head, x.tail)} for x in pdf.itertuples()], columns=["item", "range_no", "tail", "units", "lines", "after", "offsets", "is_line", "classes", "skip"])


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry state and offsets of the ranges of one text, from a few numbers per range."""
    pdf = pdf.sort_values("range_no", ignore_index=True)
    state, states = 0, []
    for after in pdf["after"]:
        states.append(state)
        state = after[state]
    u, n = pdf["units"].cumsum(), pdf["lines"].cumsum()
    return pdf[["item", "range_no"]].assign(state=states, at=u - pdf["units"], line_at=n - pdf["lines"], total=u.iloc[-1] if len(u) else 0)


def _anchor(row) -> int:
    """Where the stretch begins whose first range ``row`` is: at its line of the best class, the first of those; at its start if no line begins in it."""
    lines = [(-c, o) for o, c, b in zip(row.offsets, row.classes, row.is_line) if b]
    return int(min(lines)[1]) if lines else int(row.at)


def _cuts(pdf: pd.DataFrame, limit: int, overlap: int, per: int) -> pd.DataFrame:
    """The pieces of one stretch of ``per`` ranges, from the boundaries of its ranges, of the range before it and of the one behind it."""
    rows = list(pdf.sort_values("range_no", ignore_index=True).itertuples())
    stretch = rows[0].stretch
    own = [r for r in rows if r.range_no >= stretch * per]
    lines = np.array(sorted({int(o) for r in rows for o, b in zip(r.offsets, r.is_line) if b}), np.int64)
    begin = start = _anchor(own[0]) if stretch else 0
    stop = _anchor(own[-1]) if own[-1].range_no >= (stretch + 1) * per else int(own[0].total)
    if start:
        k = np.searchsorted(lines, start - overlap)
        whole = k < len(lines) and lines[k] < start and start in lines
        begin = int(lines[k]) if whole else max(0, start - overlap)
    bounds = [(int(o), int(c), int(b)) for r in own for o, c, b in zip(r.offsets, r.classes, r.is_line) if start < o < stop]
    pieces = choose_cuts(bounds, begin, start, stop, limit, overlap, lines)
    first = int(rows[0].line_at)
    return pd.DataFrame([(rows[0].item, s, e, first + int(np.searchsorted(lines, s, "right")) - 1) for s, e in pieces], columns=["item", "s", "e", "line_no"])


def split_ranges(ranges: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``item, piece_no, pieces, line_no, text``: the pieces of texts given as ranges.  ``line_no`` counts from 0.

    Plan: the boundaries of the ranges are written as a table.  Only a few numbers per range are put together by item; what is
    worked on at once are a stretch's boundaries, and the text of a range."""
    kind = ranges.schema["item"].dataType.simpleString()
    scanned = stored(ranges.mapInPandas(_scan, f"item {kind}, range_no int, tail int, units bigint, lines bigint, after array<int>, offsets array<bigint>, is_line array<boolean>, classes array<array<int>>, skip int"))
    # Most texts are one range, of which nothing has to be put together.
    alone = (F.col("range_no") == 0) & (F.col("tail") == 0)
    several = spread(scanned.where(~alone).select("item", "range_no", "units", "lines", "after"), "item").groupBy("item").applyInPandas(_stitch, f"item {kind}, range_no int, state int, at bigint, line_at bigint, total bigint")
    none = F.lit(0).cast("bigint")
    placed = scanned.where(alone).select("item", "range_no", F.lit(0).alias("state"), none.alias("at"), none.alias("line_at"), F.col("units").alias("total")).unionAll(several)
    per = STRETCH
    # The ranges at the borders of a stretch are its neighbours' as well.
    own = F.floor(F.col("range_no") / per).cast("int")
    stretches = F.array(own, F.when((F.col("range_no") % per == 0) & (F.col("range_no") > 0), own - 1), F.when((F.col("range_no") % per == per - 1) & (F.col("at") + F.col("units") < F.col("total")), own + 1))
    table = scanned.join(placed, ["item", "range_no"]).select(
        "item", "range_no", "at", "line_at", "total", F.transform("offsets", lambda o: o + F.col("at")).alias("offsets"), "is_line", F.element_at("classes", F.col("state") + 1).alias("classes"), F.explode(F.array_compact(stretches)).alias("stretch")
    )
    pieces = spread(table, "item", "stretch").groupBy("item", "stretch").applyInPandas(lambda pdf: _cuts(pdf, limit, overlap, per), f"item {kind}, s bigint, e bigint, line_no bigint")
    of = Window.partitionBy("item")
    pieces = pieces.withColumn("piece_no", F.row_number().over(of.orderBy("s"))).withColumn("pieces", F.count(F.lit(1)).over(of))
    # A piece lies in few ranges; it is matched to them by the blocks of units it may touch, an equi-join.
    width = RANGE // 2
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    wanted = pieces.withColumn("_block", blocks(F.col("s"), F.col("e")))
    spans = placed.join(scanned.select("item", "range_no", "units", "skip"), ["item", "range_no"]).where("units > 0").withColumn("_block", blocks(F.col("at"), F.col("at") + F.col("units")))
    parts = (
        wanted.join(spans, ["item", "_block"])
        .where((F.col("s") < F.col("at") + F.col("units")) & (F.col("e") > F.col("at")))
        .groupBy("item", "range_no", "skip")
        .agg(F.collect_set(F.struct("piece_no", "pieces", "line_no", F.greatest(F.lit(0), F.col("s") - F.col("at")).alias("lo"), (F.least(F.col("e"), F.col("at") + F.col("units")) - F.col("at")).alias("hi"), (F.col("s") >= F.col("at")).alias("begins"))).alias("cuts"))
    )

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x in pdf.itertuples():
                text = x.data[x.head + x.skip :].decode("utf-8", "replace").encode("utf-16-le")
                for c in x.cuts:
                    part = text[2 * c["lo"] : 2 * c["hi"]]
                    if c["begins"] and len(part) > 1 and 0xDC <= part[1] <= 0xDF:
                        part = part[2:]  # the second half of a pair whose first half lies before the overlap
                    rows.append((x.item, c["piece_no"], c["pieces"], c["line_no"], x.range_no, part))
            yield pd.DataFrame(rows, columns=["item", "piece_no", "pieces", "line_no", "range_no", "part"])

    cut_out = ranges.select("item", "range_no", "head", "data").join(parts, ["item", "range_no"]).mapInPandas(emit, f"item {kind}, piece_no int, pieces bigint, line_no bigint, range_no int, part binary")
    whole = cut_out.groupBy("item", "piece_no", "pieces", "line_no").agg(F.array_sort(F.collect_list(F.struct("range_no", "part"))).alias("_p"))
    return whole.select("item", "piece_no", "pieces", "line_no", F.decode(F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["part"])), "UTF-16LE").alias("text"))


def split_oversized(rows: DataFrame, *, key: str = "id", text: str = "content", start_line: str = "start_line", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``key, piece_no, pieces, start_line, text`` of every row; a text within the limit is one piece, as it is.

    Each piece has at most ``limit`` UTF-16 units.  A later piece repeats the last whole lines of the one before, up
    to ``overlap`` units, or its last ``overlap`` units where no whole line fits or the cut lies inside a line.
    ``start_line`` is the row's own plus the lines before the piece's first one; null stays null.  Null and empty
    texts are one piece; repeated rows come out repeatedly.  Characters and CRLFs stay whole, and the text is
    unchanged when the pieces without their overlaps are put together.  Other columns are ignored.  An empty table
    gives an empty result."""
    if not 0 < overlap < limit:
        raise ValueError("the overlap must be positive and less than the limit")
    base = rows.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(start_line).cast("bigint").alias("_l"))
    big = (F.octet_length("_t") > limit) & (utf16_units(F.col("_t")) > limit)
    small = base.where(F.col("_t").isNull() | ~big).select("_k", F.lit(1).alias("piece_no"), F.lit(1).cast("bigint").alias("pieces"), "_l", "_t")
    large = base.where(big).withColumn("item", F.concat_ws("/", F.hex(F.xxhash64("_k", "_l")), F.sha2("_t", 256)))
    large = large.groupBy("item", "_k", "_l").agg(F.any_value("_t").alias("_t"), F.count(F.lit(1)).alias("_copies"))
    cut = split_ranges(text_ranges(large, "item", "_t"), limit=limit, overlap=overlap)
    # The pieces of one text are many and long, so that they meet their row under SALTS keys.
    rows_of = large.select("item", "_k", "_l", "_copies", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    named = cut.withColumn("_s", F.col("piece_no") % SALTS).join(rows_of, ["item", "_s"])
    pieces = named.select("_k", "piece_no", "pieces", (F.col("_l") + F.col("line_no")).alias("_l"), "text", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")).alias("_copy")).drop("_copy")
    return small.unionAll(pieces).toDF(key, "piece_no", "pieces", start_line, text)


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the oversized chunks."""
    return split_oversized(spark.read.parquet(f"{d}/chunks.parquet")).where("pieces > 1")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that came out in pieces."""
    return p1_pieces(spark, d).select("id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLE = {"p1_found": r"SELECT DISTINCT id FROM chunks WHERE length(content) + length(regexp_replace(content, '[^\x{10000}-\x{10FFFF}]', '', 'g')) > 5000"}
