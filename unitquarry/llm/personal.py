"""Personal data in free text, by bootstrapped contextual extraction.

Every place that could hold a personal datum is a candidate: it has a key (a folded name token, the shape of a number, a
kind of street) and patterns (the words around it).  Seeds, known persons and unmistakable forms, give trust to keys.
Spark scores the graph of patterns and keys in turns: a pattern is as good as the keys it surrounds, a key as good as
the patterns around it.  Trusted patterns so find keys that no seed knows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from unitquarry.session import stored
from unitquarry.sources.tables import spread

TURNS = 3
#: Weight of doubt in a pattern's score, trust that accepts a key, and a pattern's score that accepts an unknown key.
DOUBT, TRUSTED, STRONG = 1.0, 0.5, 0.75
#: A pattern's score at least, if it holds the label of an id: such patterns are seeds, too.
LABELLED = 0.95

# Words of several languages that the candidates are made from.
_STREET_LAST = "street|st|road|rd|lane|ln|avenue|ave|way|court|ct|drive|dr|place|pl|square|terrace|crescent|close|boulevard|blvd|parkway|row|alley|walk"
_STREET_TAIL = "weg|straße|strasse|str|gasse|allee|ring|platz|zeile|ufer|damm|steig|pfad|markt|graben|hof|chaussee"
_STREET_FIRST = "Calle|C/|Plaza|Pza\\.?|Avda\\.?|Avenida|Paseo|Camino|Ronda|Rua|Av\\.?|Travessa|Praça|Largo|Alameda|Estrada|[Rr]ue|[Aa]venue|[Bb]oulevard|[Bb]d\\.?|[Pp]lace|[Cc]hemin|[Qq]uai|[Aa]llée|[Ii]mpasse|[Rr]oute|[Cc]ours|[Pp]assage|[Ss]quare"
_BOX = r"P\.? ?O\.? ?Box|Post Office Box|Postfach|Apartado(?: de [Cc]orreos| Postal)?|Apdo\.?|Caixa [Pp]ostal|C\.P\.|B\.?P\.?|Boîte [Pp]ostale"
_UNIT = r"(?:,? ?#\d+\w?|,? (?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|Room|Whg|App|Apto?|ap|apto|esc|planta|piso|puerta|bât|étage|appt)\.? ?\w{1,5}\b|, ?\d{1,2}\.?[ºª°o](?: ?(?:[A-Z]\b|(?:esq|dir|dto|izda|dcha)\b(?:\.(?=,))?))?|,? ?-? ?(?:bajo|fundos|ático|sobreloja|r/c|rés-do-chão|térreo)\b)"
_CODE = r"(?:[A-Z]{2} ?\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|(?:[A-Z]{1,2}-)?\d{5}(?:-\d{3,4})?)"
_PARTICLE = r"(?:van|von|de|da|do|del|della|dos|das|di|du|zu|ter|ten|af|el|la|le)(?: (?:der|den|la|las|los|dem))?"
_ID_LABEL = re.compile(r"passport|passeport|pasaporte|passaporte|reisepass|ausweis|steuer|idnr|identifikations|d\.?n\.?i\b|\bni[efr]\b|\bnino\b|\bni\b|\bcpf\b|\bssn\b|insurance|security|\bsec\b|sécu|seguridad|segurança|fiscal|contribuinte|sozialversicherung|\btin\b|\bcni\b", re.I)
_WORD = r"[^\W\d_]"
_PART = rf"[A-ZÀ-ÖØ-Þ](?:{_WORD}|['’](?={_WORD}))*"
_CAP = rf"(?:{_PART}(?:-{_PART})*)"

_AT, _DOT = r"(?:@|&#64;|&commat;| ?[\[({] ?(?:at|a|arroba|AT|@) ?[\])}] ?| AT | \(?at\)? (?=[\w-]+ \(?dot\)? ))", r"(?:\.| ?[\[({] ?(?:dot|punkt|point|punto|ponto|DOT|\.) ?[\])}] ?| DOT | dot )"
_EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9À-ÿ](?:[\w.+%'-]*[\w+-])?{_AT}(?:[A-Za-z0-9À-ÿ](?:[\w-]*\w)?{_DOT})+[A-Za-z]{{2,24}}(?![\w-]|\.\w)")
_EXT = r"(?:,? ?(?:ext\.?|extension|x|Durchwahl|DW|poste|ramal|ext) ?\d{1,6}\b)?"
_NUMBER = re.compile(rf"(?<![A-Za-z0-9_À-ɏ$#@\-/,+])(?<!\d\.)(?:[+(]|\+\()?\d(?:[ ./\-]?[()]?[ ./\-]?\d){{6,17}}(?![\w$@]|[-./]\w)({_EXT})")
_ALNUM = re.compile(r"(?<![\w$#@\-/.{])(?:[A-Z]{1,2}-? ?\d{6,9}[A-Z]?|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|\d{2}[A-Z]{2}\d{5,6}|(?=[A-Z\d]*[A-Z])(?=(?:[A-Z]*\d){5})[A-Z\d]{8,13}|\d{2}\.?\d{3}\.?\d{3} ?-? ?[A-Z]|[XYZ] ?-? ?\d{7} ?-? ?[A-Z])(?![\w@}]|-\w)", re.I)
_NAME = re.compile(rf"(?<![\w@&/\\#$%+-])(?:(?P<particle>{_PARTICLE}) )?(?:(?P<initials>(?:[A-ZÀ-Þ]\.[ -]{{0,2}}){{1,3}})(?= *[A-ZÀ-Þ\w])|(?P<name>{_CAP})(?![\w@(]|\.\w|/\w|-\w|::))")
_GLUE = re.compile(r"(?P<blank>[ \t]{1,3})|(?P<comma>, {1,2})")
_CONTEXT = re.compile(r"[^\W\d_]+|\d+|\r?\n|[^\w\s]")
_STREETS = [
    ("last", re.compile(rf"(?<![\w.,$#-])\d{{1,5}}[A-Z]?(?:-\d{{1,4}})?,? (?:{_CAP} ){{1,4}}(?P<key>{_CAP})(?![\w'’-])")),
    ("first", re.compile(rf"(?:(?<![\w.,$#-])\d{{1,5}}(?: ?(?:bis|ter|quater))?,? )?(?<![\w.])(?P<key>{_STREET_FIRST})(?: (?:de|del|da|do|das|dos|la|las|los|du|des|le|les|el|l['’]|d['’]))*(?: ?{_CAP}| (?:de|del|da|do|das|dos|la|du|des)(?= )){{1,5}}(?:,? (?:n\.? ?[ºo°]|nº|n°|número)? ?\d{{1,5}}[A-Za-z]?\b)?")),
    ("tail", re.compile(rf"(?<![\w.-])(?:{_CAP} ){{0,3}}(?P<key>{_CAP}) \d{{1,4}} ?[a-z]?\b(?![.,:\-/]?\d|%|\w)")),
    ("box", re.compile(rf"(?<![\w.])(?P<key>{_BOX}) \d{{1,6}}\b")),
]
_UNITS = re.compile(rf"(?:{_UNIT})*")
_TOWN = rf"{_CAP}(?: {_CAP})?"
_PLACE = re.compile(rf"(?:,? ?(?:in |à |en |em )?|,? ?\r?\n ?|, )(?:(?P<code1>{_CODE}),? (?P<town1>{_TOWN})|(?P<town2>{_TOWN}),? (?P<code2>{_CODE})\b|(?P<town3>{_TOWN}))(?!\w)")

_PLAIN = {c: "-" for c in range(0x2010, 0x2016)} | {0x2212: "-"}


def _straight(text: str) -> str:
    """``text`` with full-width and other unusual forms of characters as the usual ones, each in its place."""
    if text.isascii():
        return text
    out = []
    for c in text:
        n = _PLAIN.get(ord(c)) or (c if c < "\xa0" else unicodedata.normalize("NFKC", c))
        out.append(n if len(n) == 1 else c)
    return "".join(out)


def fold(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name.replace("’", "'")) if not unicodedata.combining(c)).lower()


def _shape(number: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", re.sub(r"\s", " ", number.upper())))


def _around(text: str, start: int, end: int, names: bool = True) -> tuple[str, str, str]:
    """The two and three words or marks before a place and the two behind it; without ``names``, a capitalised word that is no label counts as any other."""

    def plain(w: str) -> str:
        return "\n" if not w.strip() else "0" if w.isdigit() else "A" if not names and w[0].isupper() and len(w) > 2 and not _ID_LABEL.search(w) else w.lower()

    left = [plain(w) for w in _CONTEXT.findall(text, max(0, start - 40), start)[-3:]]
    right = [plain(w) for w in _CONTEXT.findall(text, end, end + 24)[:2]]
    return "l2 " + " ".join(left[-2:]), "l3 " + " ".join(left), "r2 " + " ".join(right)


def _number(cls: str, text: str) -> int:
    return xxhash.xxh64_intdigest(cls + text) - (1 << 63)


def candidates(doc: object, raw: str) -> Iterator[tuple]:
    """The candidates of one text, in the order of ``_FOUND``.

    ``cls``: e (email), d (number), s (street), n (name token), i (initials, which have no key).  Keys and patterns are
    numbers that hash them; ``label`` has bit 1 or 2 where the two or three words before are an id's label."""
    text = _straight(raw)

    def row(cls: str, start: int, end: int, key: str, seed: str | None, around: tuple[str, str, str], glue: str | None = None, prev: int = -1, coded: bool = False, towns: tuple[str, str] = ("", ""), ends: tuple[int, int] = (0, 0)) -> tuple:
        label = (1 if _ID_LABEL.search(around[0]) else 0) + (2 if _ID_LABEL.search(around[1]) else 0) if cls == "d" else 0
        return (doc, cls, start, end, _number(cls, key), seed, label, *(_number(cls, x) for x in around), glue, prev, coded, *(_number("t", t) if t else None for t in towns), *ends)

    taken = []
    for m in _EMAIL.finditer(text):
        # the form is plain, or disguised by words or entities
        taken.append((m.start(), m.end()))
        plain = m[0].count("@") == 1 and " " not in m[0] and "[" not in m[0]
        yield row("e", m.start(), m.end(), "plain" if plain else "disguised", "email", _around(text, m.start(), m.end(), False))
    free = lambda s, e: not any(a < e and s < b for a, b in taken)
    for how, pattern in _STREETS:
        for m in pattern.finditer(text):
            if not free(m.start(), m.end()):
                continue
            begin, stop, word = m.start(), m.end(), fold(m["key"]).rstrip(".")
            seed = how in ("box", "first")
            if how == "last":
                # the last of the words that is a kind of street ends the street; else two words and their last one stand for it
                words = list(re.finditer(_CAP, m[0]))
                kinds = [w for w in words[1:] if re.fullmatch(_STREET_LAST, fold(w[0]))]
                seed = bool(kinds)
                w = kinds[-1] if kinds else words[min(1, len(words) - 1)]
                stop, word = begin + w.end(), fold(w[0])
            if how == "tail":
                lead = re.match(r"(?:Am|Zum|Zur|An der|Im|Auf der|Auf dem|Hinter der|Unter den|In der)\b", m[0])
                if lead and lead.end() == m.end("key") - begin:
                    continue
                seed = bool(lead) or bool(re.search(rf"(?:{_STREET_TAIL})$", word))
                word = ("^" + lead[0].lower()) if lead else word if "-" not in word else word.rsplit("-", 1)[1]
                if not lead:
                    begin = m.start("key")
            if how == "first" and not re.search(r"\d", m[0]):
                continue
            # the point of an abbreviation belongs to it if the address goes on
            dot = text[stop : stop + 1] == "." and how == "last"
            end = _UNITS.match(text, stop + dot).end()
            p = _PLACE.match(text, end)
            if dot and end == stop + 1:
                end = stop
            town = fold(p["town1"] or p["town2"] or p["town3"]) if p else ""
            # A town is known by the postcode beside it; without one the address ends before it, or behind its first word, unless the town is trusted.
            first = fold(p["town3"].split(" ")[0]) if p and p["town3"] else ""
            first = first if first != town else ""
            far = p.end() if p else end
            yield row("s", begin, end, how + " " + word, "address" if seed else None, _around(text, begin, end), coded=bool(p and (p["code1"] or p["code2"])), towns=(town, first), ends=(far, far - len(town) + len(first) if first else end))
    for m in _NUMBER.finditer(text):
        if free(m.start(), m.end()):
            end, begin = m.start(1) if m[1] else m.end(), m.start()
            begin += text[begin] == "(" and ")" not in text[begin:end]
            number = text[begin:end]
            if number.count("(") != number.count(")"):
                continue
            shape = _shape(number)
            digits = re.sub(r"[^9]", "", shape)
            seed = "phone" if re.match(r"\+|00[1-9]", number) and 9 <= len(digits) <= 15 or m[1] else "id_number" if shape in ("999-99-9999", "999.999.999-99") else None
            yield row("d", begin, m.end(), "+" if seed == "phone" else shape, seed, _around(text, begin, m.end(), False))
    for m in _ALNUM.finditer(text):
        if free(m.start(), m.end()) and re.search("[A-Za-z]", m[0]):
            shape = _shape(m[0])
            yield row("d", m.start(), m.end(), shape, "id_number" if re.fullmatch(r"AA ?99 ?99 ?99 ?A|99999999-?A", shape) else None, _around(text, m.start(), m.end(), False))
    last = lead = prev = -1
    for m in _NAME.finditer(text):
        name = m["name"]
        start = m.start("name") if name else m.start("initials")
        end = m.end("name") if name else start + len(m["initials"].rstrip(" -"))
        if name and (len(name) < 3 or not name.isupper() and re.search(r"(?:[a-zß-ÿ])[A-ZÀ-Þ]", name.replace("Mc", ""))) or not free(start, end):
            last = lead = -1
            continue
        gap = _GLUE.fullmatch(text, last, m.start()) if last >= 0 else None
        # what stands before initials is what stands before the name
        lead = lead if gap and gap.lastgroup == "blank" and lead >= 0 else start
        glue = gap.lastgroup if gap else None
        if name:
            yield row("n", start, end, fold(name), None, _around(text, lead, end), glue, prev)
        else:
            yield (doc, "i", start, end, None, None, 0, None, None, None, glue, prev, False, None, None, 0, 0)
        last, lead, prev = end, -1 if name else lead, end


_FOUND = "cls string, start int, end int, k bigint, seed string, label int, l2 bigint, l3 bigint, r2 bigint, glue string, prev int, coded boolean, t1 bigint, t2 bigint, far int, near int"


def _spans(rows: list) -> list[tuple]:
    """Non-overlapping (start, end, kind) of the accepted candidates of one document, best kinds first."""
    out: list[tuple[int, int, str]] = []

    def put(s: int, e: int, kind: str) -> None:
        if not any(a < e and s < b for a, b, _ in out):
            out.append((s, e, kind))

    rank = {"email": 0, "address": 1, "id_number": 2, "phone": 3}
    for x in sorted((x for x in rows if x.cls not in "ni"), key=lambda x: (rank[x.kind], x.start, -x.stop)):
        put(x.start, x.stop, x.kind)
    run: list = []

    def close() -> None:
        sure = [i for i, x in enumerate(run) if x.cls == "n" and x.kind == "person"]
        # initials don't come between a name and a rare word that goes with it
        beside = {k + step * (2 if 0 <= k + step < len(run) and run[k + step].cls == "i" else 1) for k in sure for step in (-1, 1)}
        keep = [x for i, x in enumerate(run) if x.kind == "person" or i in beside]
        if sure:
            first, last = run.index(keep[0]), run.index(keep[-1])
            whole = run[first : last + 1]
            while whole and whole[-1].cls == "i":
                whole.pop()
            put(whole[0].start, whole[-1].end, "person")
        run.clear()

    for x in sorted((x for x in rows if x.cls in "ni"), key=lambda x: x.start):
        names = [y for y in run if y.cls == "n"]
        adjacent = run and x.start >= run[-1].end and (x.glue == "blank" or x.glue == "comma" and len(run) == 1 and len(names) == 1 and x.cls == "n")
        if not adjacent or x.prev != run[-1].end or len(names) >= 4 or (len(names) >= 2 and any(y.glue == "comma" for y in run) and x.cls == "n"):
            close()
        run.append(x)
    close()
    return out


def _graph(found: DataFrame) -> DataFrame:
    """``cls, p, k, n, all, label``: how often each pattern stands beside each key, and beside any.

    A pattern that stands in the whole corpus once can only echo its own key, half as loud, so that it needn't be sent
    around: such edges are left out here and are put back as numbers per key, with the same result."""
    side = lambda p, label: F.struct(F.col(p).alias("p"), label.cast("int").alias("label"))
    pairs = F.explode(F.array(side("l2", F.col("label") % 2), side("l3", F.floor(F.col("label") / 2)), side("r2", F.lit(0)))).alias("e")
    edges = found.where("cls <> 'i'").select("cls", "k", pairs).groupBy("cls", "k", F.col("e.p").alias("p"), F.col("e.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    spread = edges.groupBy("p").agg(F.sum("n").alias("all"), F.max("label").alias("_label")).where("all > 1 or _label > 0").select("p", "all")
    return edges.join(spread, "p").select("cls", "p", "k", "n", "all", "label")


def _scored(graph: DataFrame, trust: DataFrame, all_numbers: bool = False) -> DataFrame:
    """``cls, p, kind, score, all, label`` of the patterns, by the trust of the keys beside them; a label before a number
    makes it an id at least as surely as ``LABELLED``.  With ``all_numbers``, patterns of numbers that no trusted key has come out, too, without a kind."""
    met = graph.join(trust.select("k", "kind", "trust"), "k", "left" if all_numbers else "inner")
    met = met.where("kind is not null or cls = 'd'") if all_numbers else met
    score = met.groupBy("cls", "p", "kind", "all").agg((F.coalesce(F.sum(F.col("n") * F.col("trust")), F.lit(0.0)) / (F.col("all") + DOUBT)).alias("score"), F.max("label").alias("label"))
    labels = graph.where("label > 0").select("cls", "p", F.lit("id_number").alias("kind"), "all", F.lit(LABELLED).alias("score"), "label").distinct()
    return score.unionByName(labels).groupBy("cls", "p", "kind", "all").agg(F.max("score").alias("score"), F.max("label").alias("label"))


def find_personal(docs: DataFrame, persons: DataFrame, *, key: str = "doc_id", text: str = "text", turns: int = TURNS) -> DataFrame:
    """``key, start_pos, end_pos, kind``: each occurrence of an email, phone, id_number, address or person.

    Positions count code points from 0, the end is exclusive; occurrences of a document don't overlap.  ``persons``
    has the known persons' given_name and surname; null names give no seed.  Null and empty texts and null keys give no rows.  Of rows
    that repeat key and text, each occurrence comes out once.  Other columns are ignored; an empty table gives an empty result.

    Plan: one pass over the texts yields candidates, which are written as a table; the graph of patterns and keys is
    one row per distinct edge, counted before it is sent; in each of ``turns`` turns it is scored by a join on the key and one on the
    pattern, which are numbers.  Of the candidates only those that may yet be accepted go on; all that
    is known of a candidate's contexts and town comes by one more join.  Frequent keys and patterns are left to
    Spark's splitting of skewed joins, as are joins with a side small enough to be sent to all tasks."""
    kind = docs.schema[key].dataType.simpleString()
    schema = to_arrow_schema(_parse_datatype_string(f"doc {kind}, {_FOUND}"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [c for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in candidates(d, t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    base = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") > 0))
    found = stored(base.mapInArrow(read, f"doc {kind}, {_FOUND}"))
    graph = stored(_graph(found))

    @F.pandas_udf("array<bigint>")
    def tokens(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [_number("n", fold(x)) for x in re.findall(_CAP, n) if len(fold(x)) > 2])

    known = persons.select(F.explode(F.array("given_name", "surname")).alias("name")).where("length(name) > 1")
    known = known.select(F.explode(tokens("name")).alias("k")).distinct().withColumn("_person", F.lit("person"))
    # n: how often a key occurs; rare: how often with a pattern that occurs once.
    sizes = found.where("cls <> 'i'").groupBy("cls", "k").agg(F.count(F.lit(1)).alias("n"), F.min("seed").alias("seed"))
    keys = sizes.join(graph.groupBy("k").agg(F.sum("n").alias("_m")), "k", "left").join(known, "k", "left")
    keys = stored(keys.select("cls", "k", "n", (3 * F.col("n") - F.coalesce("_m", F.lit(0))).alias("rare"), F.coalesce("seed", "_person").alias("seed")))
    trust = keys.where("seed is not null").select("k", F.col("seed").alias("kind"), F.lit(1.0).alias("trust"), "rare")
    echo = (F.col("rare") * F.col("trust") / (1 + DOUBT)).alias("sum")
    for _ in range(turns - 1):
        met = graph.join(_scored(graph, trust).select("p", "kind", "score"), "p").select("k", "kind", (F.col("n") * F.col("score")).alias("sum"))
        mean = met.unionByName(trust.select("k", "kind", echo)).groupBy("k", "kind").agg(F.sum("sum").alias("sum")).join(keys, "k")
        learned = F.least(F.lit(1.0), F.col("sum") / (3 * F.col("n") + 0.2) * 1.2)
        trust = stored(mean.select("k", "kind", F.when(F.col("seed") == F.col("kind"), F.lit(1.0)).otherwise(learned).alias("trust"), "rare").where("trust >= 0.25"))
    scored = stored(_scored(graph, trust, all_numbers=True))
    met = graph.where("cls = 'n'").join(scored.where("cls = 'n'").select("p", "score"), "p").select("k", (F.col("n") * F.col("score")).alias("sum"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("double").alias("trust"))
    per = met.unionByName(trust.select("k", echo, "kind", "trust")).groupBy("k").agg((F.sum("sum") / 3).alias("met"), F.max_by("kind", "trust").alias("k_kind"), F.max("trust").alias("sure"))
    per = keys.select("cls", "k", "n").join(per, "k", "left").select("cls", "k", "n", F.coalesce("met", F.lit(0.0)).alias("met"), "k_kind", F.coalesce("sure", F.lit(0.0)).alias("sure"))
    # A word that is often met elsewhere is no name, however good the pattern; a rare word goes with a name beside it, as an unknown given name or surname.
    few, beside = (F.col("n") - F.col("met") <= 3), (F.col("n") <= 3) | ((F.col("n") <= 9) & (F.col("met") >= 0.1 * F.col("n")))
    per = per.select("k", "k_kind", "sure", few.alias("few"), beside.alias("beside")).where((F.col("cls") != "n") | (F.col("sure") >= TRUSTED) | F.col("few") | F.col("beside"))
    place = ["doc", "cls", "start", "end"]
    rest = ["glue", "prev", "far", "near", "coded", "k_kind", "sure", "few", "beside"]
    open_ = stored(found.where("k is not null").join(per, "k").select(*place, *rest, "l2", "l3", "r2", "t1", "t2"))
    # Only what can decide is joined: good patterns, and for numbers those that are known to be bad as well; towns are known where a postcode stands beside them.
    numbers = scored.where("cls = 'd' and (all >= 4 or label > 0)")
    say = scored.where((F.col("cls") == "n") & (F.col("score") >= STRONG) | F.col("cls").isin("s", "e") & (F.col("score") >= TRUSTED)).unionByName(numbers).groupBy("p").agg(F.max_by("kind", "score").alias("said"), F.max("score").alias("score"))
    towns = found.where("coded").select(F.explode(F.array("t1", "t2")).alias("p")).where("p is not null").distinct()
    say = say.unionByName(towns.select("p", F.lit("town").alias("said"), F.lit(1.0).alias("score")))
    sides = F.posexplode(F.array("l2", "l3", "r2", "t1", "t2")).alias("side", "p")
    marks = open_.where(f"cls <> 'n' or few and sure < {TRUSTED}").select(*place, sides).where("p is not null").join(say, "p").select(*place, "side", "said", "score")
    # All rows of a text meet once: those of one candidate become one, then those of the text are put together.
    alone = found.where("cls = 'i'").select(*place, "glue", "prev", "far", "near", "coded")
    rows = open_.select(*place, *rest).unionByName(alone, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True).repartition("doc").groupBy(*place)
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    rows = rows.agg(*(F.max(c).alias(c) for c in rest), *(of(i, "said").alias(f"said{i}") for i in range(3)), *(of(i, "score").alias(f"score{i}") for i in range(5)))
    seen = F.col("score0").isNotNull() | F.col("score1").isNotNull()
    left = F.greatest(F.coalesce("score0", F.lit(0.0)), F.coalesce("score1", F.lit(0.0)))
    left_kind = F.when(F.coalesce("score1", F.lit(0.0)) >= F.coalesce("score0", F.lit(0.0)), F.col("said1")).otherwise(F.col("said0"))
    number = F.when(left >= TRUSTED, left_kind).when((F.col("score2") >= TRUSTED) & (F.col("sure") >= 0.3), F.col("said2")).when((F.col("sure") >= 0.8) & ~(seen & (left < 0.15)), F.col("k_kind"))
    name = F.when((F.col("sure") >= TRUSTED) | ((left >= STRONG) & F.col("few")), F.lit("person")).when(F.col("beside"), F.lit("maybe"))
    fixed = F.when((F.col("sure") >= TRUSTED) | (left >= TRUSTED), F.when(F.col("cls") == "s", F.lit("address")).otherwise(F.lit("email")))
    decided = F.when(F.col("cls") == "d", number).when(F.col("cls") == "n", name).when(F.col("cls") == "i", F.lit("person")).otherwise(fixed)
    stop = F.when(F.col("cls") != "s", F.col("end")).when(F.col("coded") | F.col("score3").isNotNull(), F.col("far")).when(F.col("score4").isNotNull(), F.col("near")).otherwise(F.col("end"))
    accepted = rows.select("doc", "cls", "start", "end", stop.alias("stop"), decided.alias("kind"), "glue", "prev").where("kind is not null")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list = []
        columns = ["doc", "start_pos", "end_pos", "kind"]
        for pdf in batches:
            out = []
            for x in pdf.itertuples(index=False):
                if rows and x.doc != rows[0].doc:
                    out += [(rows[0].doc, *s) for s in _spans(rows)]
                    rows = []
                rows.append(x)
            yield pd.DataFrame(out, columns=columns)
        if rows:
            yield pd.DataFrame([(rows[0].doc, *s) for s in _spans(rows)], columns=columns)

    # The rows of one text are in one task already, which sees them in order; a text is never larger than a row.
    merged = accepted.sortWithinPartitions("doc", "start").mapInPandas(merge, f"doc {kind}, start_pos bigint, end_pos bigint, kind string")
    return merged.toDF(key, "start_pos", "end_pos", "kind")


def redact(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[PERSON]`` in place of each occurrence.  Texts without occurrences, null ones too, come out as they are; keys must be unique."""
    marks = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("_m"))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    step = lambda a, m: F.struct(F.concat(a["done"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (m["start_pos"] - a["at"]).cast("int")), F.lit("["), F.upper(m["kind"]), F.lit("]")).alias("done"), m["end_pos"].alias("at"))
    rest = lambda a: F.concat(a["done"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text)))
    return docs.select(key, text).join(marks, key, "left").select(key, F.when(F.col("_m").isNull(), F.col(text)).otherwise(F.aggregate("_m", start, step, rest)).alias(text))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_personal(spread(spark.read.parquet(f"{d}/documents.parquet")), spark.read.parquet(f"{d}/contributors.parquet"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return redact(docs, find_personal(spread(docs), spark.read.parquet(f"{d}/contributors.parquet")))


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLE: dict[str, str] = {}
