"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table, in as many partitions as there are cores at least: a small table may come as one split, on which one
    task would do all the work in Python.  Tables with more splits are left as they are, so that large ones aren't sent."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
