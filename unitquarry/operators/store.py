"""The store: a Parquet table of chunks, partitioned by library and version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("library", "version", "unit_name", "file_path", "section", "chunk_type", "identifier", "content")]
    + [T.StructField("start_line", T.IntegerType()), T.StructField("visibility", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


def evolved(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of the schema that they lack, as nulls, in the schema's order; names are matched without regard to case."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*[F.col(have[f.name]).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA])


def append(rows: DataFrame, path: str) -> None:
    """Add rows; whatever a version is called, it is a text."""
    evolved(rows).write.mode("append").partitionBy("library", "version").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return evolved(spark.read.schema(SCHEMA).parquet(path))


def delete_scope(rows: DataFrame, scopes: DataFrame) -> DataFrame:
    """The rows that stay when ``scopes`` (library, version; a null version stands for all) are deleted."""
    a, b = rows.alias("a"), scopes.select("library", "version").distinct().alias("b")
    return a.join(b, (F.col("a.library") == F.col("b.library")) & (F.col("b.version").isNull() | (F.col("a.version") == F.col("b.version"))), "left_anti")


def overwrite_scopes(rows: DataFrame, path: str) -> None:
    """Replace the partitions that ``rows`` belong to, and no others."""
    evolved(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("library", "version").parquet(path)


def compact(spark: SparkSession, path: str, to: str, *, files: int = 1) -> None:
    """Write the table anew to ``to`` with about ``files`` files a partition."""
    read(spark, path).withColumn("_f", F.pmod(F.xxhash64("id"), F.lit(files))).repartition("library", "version", "_f").drop("_f").write.mode("overwrite").partitionBy("library", "version").parquet(to)


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("library", "version").agg(F.count(F.lit(1)).alias("chunks"))


def first_embedding(rows: DataFrame) -> DataFrame:
    """``library, version, id, embedding`` of the smallest id of each scope."""
    return rows.groupBy("library", "version").agg(F.min("id").alias("id"), F.min_by("embedding", "id").alias("embedding"))
