"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def canonical_text(text: Column) -> Column:
    """``text`` with CRLF as LF and without blanks and tabs at line ends; null stays null.

    The look-behind lets a run of blanks be tried once only, so a long run costs no more than its length."""
    return F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"(?<![ \t])[ \t]++(?=\n|\z)", "")


def snapshot_order(rows: DataFrame, releases: DataFrame, *, scope: str = "library", version: str = "version", at: str = "released_at") -> DataFrame:
    """One row per snapshot of ``rows``: ``scope, version, snap`` (1, 2, ... in time) and ``snaps``, the scope's number of them.

    A version that ``releases`` doesn't list, or lists without a time, comes before the dated ones, by its text;
    one listed several times counts from its first time."""
    there = rows.select(scope, version).distinct()
    when = releases.groupBy(scope, version).agg(F.min(at).alias("_at"))
    same = there[scope].eqNullSafe(when[scope]) & there[version].eqNullSafe(when[version])
    order = Window.partitionBy(scope).orderBy(F.col("_at").asc_nulls_first(), F.col(version).asc_nulls_first())
    return there.join(when, same, "left").select(there[scope], there[version], "_at").select(
        scope, version, F.row_number().over(order).alias("snap"), F.count(F.lit(1)).over(Window.partitionBy(scope)).alias("snaps")
    )


def snapshot_changes(
    rows: DataFrame,
    releases: DataFrame,
    *,
    scope: str = "library",
    version: str = "version",
    at: str = "released_at",
    keys: Sequence[str] = ("unit_name", "section", "chunk_type", "identifier"),
    lower_out: Sequence[str] = ("unit_name", "identifier"),
    content: str = "content",
) -> DataFrame:
    """Records added, removed or changed in each snapshot against the preceding one of its scope.

    Result: ``scope, version, *keys, change_kind``.  ``version`` is the later snapshot of the two; the first one
    of a scope has no rows.  Keys are compared without regard to case; those in ``lower_out`` come out in lower
    case, the others in the spelling that sorts first.  The content of a record is the set of the distinct
    canonical texts stored under its key, so repeated rows and their order don't matter; null differs from any
    text.  Null keys are values like any other.  Other columns of ``rows`` are ignored.  An empty table gives an
    empty result.

    Plan: rows are reduced to one 128-bit hash per distinct text *before* the key windows, with the text's hash in
    the first shuffle key, so that one key which holds a large share of all rows is spread over all tasks.  The
    window of a key then has at most one row per snapshot: lag hashes give changes, gaps in the snapshot numbers
    give removals and later additions."""
    text = canonical_text(F.col(content))
    slim = rows.select(
        F.col(scope).alias("_scope"),
        F.col(version).alias("_version"),
        *[F.lower(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)],
        F.xxhash64(F.lit(1), F.col(content).isNull(), text).alias("_h1"),
        F.xxhash64(F.lit(2), F.col(content).isNull(), text).alias("_h2"),
    )
    key = [f"_k{i}" for i in range(len(keys))]
    shown = [F.min(f"_s{i}").alias(f"_s{i}") for i in range(len(keys))]
    distinct = slim.groupBy("_scope", "_version", *key, "_h1", "_h2").agg(*shown)
    records = distinct.groupBy("_scope", "_version", *key).agg(
        *shown, F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor("_h1").alias("a"), F.bit_xor("_h2").alias("b")).alias("_text")
    )
    snaps = snapshot_order(rows, releases, scope=scope, version=version, at=at).toDF("_s_scope", "_s_version", "snap", "snaps")
    same = records["_scope"].eqNullSafe(snaps["_s_scope"]) & records["_version"].eqNullSafe(snaps["_s_version"])
    numbered = records.join(snaps, same).drop("_s_scope", "_s_version", "_version")
    line = Window.partitionBy("_scope", *key).orderBy("snap")
    seen = numbered.withColumns({"_before": F.lag("snap").over(line), "_after": F.lead("snap").over(line), "_old": F.lag("_text").over(line)})
    events = F.array_compact(
        F.array(
            F.when((F.col("snap") > 1) & (F.col("_before").isNull() | (F.col("_before") < F.col("snap") - 1)), F.struct(F.lit("added").alias("kind"), F.col("snap").alias("at"))),
            F.when((F.col("_before") == F.col("snap") - 1) & (F.col("_old") != F.col("_text")), F.struct(F.lit("changed").alias("kind"), F.col("snap").alias("at"))),
            F.when(
                (F.col("snap") < F.col("snaps")) & (F.col("_after").isNull() | (F.col("_after") > F.col("snap") + 1)), F.struct(F.lit("removed").alias("kind"), (F.col("snap") + 1).alias("at"))
            ),
        )
    )
    found = seen.select("_scope", *key, *[f"_s{i}" for i in range(len(keys))], F.explode(events).alias("_event"))
    back = snaps.select(F.col("_s_scope"), F.col("_s_version"), F.col("snap").alias("_at"))
    return found.join(back, found["_scope"].eqNullSafe(back["_s_scope"]) & (found["_event.at"] == back["_at"])).select(
        F.col("_scope").alias(scope),
        F.col("_s_version").alias(version),
        *[F.col(f"_k{i}" if k in lower_out else f"_s{i}").alias(k) for i, k in enumerate(keys)],
        F.col("_event.kind").alias("change_kind"),
    )
