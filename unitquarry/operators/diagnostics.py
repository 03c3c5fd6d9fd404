"""The diagnostics pipeline: repetitions dropped, worst first, capped per file, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST = 500
SPAN = ("start_line", "start_column", "end_line", "end_column")


def severity_rank(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low == "error", 0).when(low == "warning", 1).when(low == "info", 2).otherwise(3)


def distinct(rows: DataFrame) -> DataFrame:
    """One row per file, code, severity in any case, message, place and hint; a null hint equals an empty one.  Map-side aggregation keeps a file with many repetitions small."""
    key = [F.col("file_id"), F.coalesce("code", F.lit("")).alias("code"), F.initcap(F.lower("severity")).alias("severity"), F.coalesce("message", F.lit("")).alias("message"), *[F.col(f"span.{c}").alias(c) for c in SPAN], F.coalesce("recovery_hint", F.lit("")).alias("hint")]
    return rows.select(*key).groupBy("file_id", "code", "severity", "message", *SPAN, "hint").agg(F.count(F.lit(1)).alias("repeats"))


def ordered(rows: DataFrame, *, most: int = MOST) -> DataFrame:
    """The distinct diagnostics of a file, worst severity first, then by place and code, at most ``most``."""
    if most < 1:
        raise ValueError("the cap must be positive")
    order = Window.partitionBy("file_id").orderBy(severity_rank(F.col("severity")), F.col("start_line").asc_nulls_first(), F.col("start_column").asc_nulls_first(), "code", "message", F.col("end_line").asc_nulls_first(), F.col("end_column").asc_nulls_first(), "hint")
    return distinct(rows).withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= most)


def report(rows: DataFrame, *, most: int = MOST) -> DataFrame:
    """``file_id, total, returned, errors, warnings, infos, truncated``."""
    n = lambda s: F.count_if(F.col("severity") == s).cast("bigint")
    return distinct(rows).groupBy("file_id").agg(F.count(F.lit(1)).alias("total"), F.least(F.count(F.lit(1)), F.lit(most).cast("bigint")).alias("returned"), n("Error").alias("errors"), n("Warning").alias("warnings"), n("Info").alias("infos"), (F.count(F.lit(1)) > most).alias("truncated"))
