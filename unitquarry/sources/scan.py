"""Reading source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Windows ignores the case of names, so both are read.
PASCAL = "*.[pP][aA][sS]"


def _numbered(files: DataFrame, library: str, version: str) -> DataFrame:
    return files.select(F.xxhash64(F.lit(library), F.lit(version), "file_path").alias("file_id"), F.lit(library).alias("library"), F.lit(version).alias("version"), "file_path", "source_text")


def scan_tree(spark: SparkSession, root: str, library: str, version: str) -> DataFrame:
    """``file_id, library, version, file_path, source_text`` of all units below ``root``; unreadable files are left out (``unreadable`` counts them).  The id is a hash of scope and path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", PASCAL).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).text(root, wholetext=True)
    return _numbered(files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("source_text")), library, version)


def unreadable(spark: SparkSession, root: str, files: DataFrame) -> int:
    """How many units below ``root`` ``files`` lacks, as they couldn't be read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", PASCAL).load(root).select(F.col("path").alias("file_path"))
    return listed.join(files.select("file_path"), "file_path", "left_anti").count()


def stream_tree(spark: SparkSession, root: str, library: str, version: str) -> DataFrame:
    """The same as a stream of the files that come in."""
    files = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", PASCAL).option("wholetext", True).format("text").load(root)
    return _numbered(files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("source_text")), library, version)
