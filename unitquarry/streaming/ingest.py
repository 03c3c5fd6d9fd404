"""Adding the files that come in to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unitquarry.functions.embedding import Embedder, embedded
from unitquarry.operators import chunker, store
from unitquarry.sources.scan import stream_tree


def keyed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with an id that depends on scope, file and place only, so that a batch that runs twice gives the same ids."""
    return chunks.withColumn("id", F.xxhash64("library", "version", "file_path", "ordinal"))


def ingest_available(spark: SparkSession, root: str, library: str, version: str, path: str, checkpoint: str, embedder: Embedder) -> StreamingQuery:
    """Chunk, embed and append all files that weren't seen yet, then stop.  The checkpoint knows the files that were."""

    def add(batch: DataFrame, number: int) -> None:
        store.append(embedded(keyed(chunker.chunk_files(batch)), embedder), path)

    files = stream_tree(spark, root, library, version)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
