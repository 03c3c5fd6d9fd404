"""Encoding of a whole corpus with a public tokenizer, by a table of its distinct words."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files are; every executor opens them there.
VOCABULARIES = "/opt/tokenizers"
TOKENIZER, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Bytes of text of a block, about, and of a task.  The words of a block are looked up together.
BLOCK, TASK = 8 << 20, 128 << 20
#: Blocks whose rows of one word go to one task.
PART = 4096

_BLANK = r"\t-\r \x85\xA0  -     　"
#: The tokenizer's own split, with white space spelled out, as Java's \s is ASCII only.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"


def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def _encode_with(path: str):
    """Texts in the last column of each batch become their ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(path)
            ids = pa.array(encoder(batch.column(batch.num_columns - 1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return encode


def encode_corpus(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str = f"{VOCABULARIES}/{TOKENIZER}", block: int = BLOCK) -> DataFrame:
    """``key, ids``: the token ids of every row, without special tokens; their strings in a text are ordinary text.

    Null and empty texts give an empty list.  Every row comes out, repeated and null keys included.  Other columns
    are ignored; an empty table gives an empty result.

    Plan: rows are laid out in blocks, words are split in the JVM.  Each block sends its distinct words only; these
    are sorted, each distinct word is encoded once (once for PART blocks), and goes back to the blocks that hold it, where ids are put in
    place by position.  So a frequent word costs one row per block, not one per occurrence.  A text with a
    character that the JVM's Unicode tables don't know yet is encoded as a whole instead, as its split may differ."""
    return _encoded(docs, key, text, path, block, False).toDF(key, "ids")


def count_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str = f"{VOCABULARIES}/{TOKENIZER}", block: int = BLOCK) -> DataFrame:
    """``key, n_tokens``: how many ids ``encode_corpus`` gives, by the same way, but only numbers of ids are put in place."""
    return _encoded(docs, key, text, path, block, True).toDF(key, "n_tokens")


def _encoded(docs: DataFrame, key: str, text: str, path: str, block: int, counts: bool) -> DataFrame:
    spark = docs.sparkSession
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    strange = F.col("text").rlike(r"\p{Cn}")
    kind = docs.schema[key].dataType.simpleString()
    total = docs.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block))
    width = max(-(-total // TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = base.where(~strange).withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)).cast("int")).repartition(width, "block").select("block", "key", F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("words"))
    pairs = placed.select(F.col("block").alias("home"), F.explode("words").alias("word")).distinct()
    value, wanted = ("ids", "array<int>") if not counts else ("n", "int")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(path)
            words = batch.column(1).dictionary_encode()
            ids = encoder(words.dictionary.to_pylist())
            own = pa.array(map(len, ids), pa.int32()) if counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, own.take(words.indices)], ["home", "word", value])

    # The rows of a word lie beside each other, so that it is encoded once; those of a word that nearly all blocks have are dealt by their blocks.
    coded = pairs.repartition("word", F.floor(F.col("home") / PART)).sortWithinPartitions("word").mapInArrow(encode, f"home int, word string, {value} {wanted}")

    def put(texts: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        known, own = table.column("word").combine_chunks(), table.column(value).combine_chunks()
        for keys, words in zip(texts.column("key").chunks, texts.column("words").chunks):
            for at in range(0, len(words), 512):
                some = words.slice(at, 512)
                place = pc.index_in(some.flatten(), value_set=known) if len(known) else pa.array([], pa.int32())
                mine = own.take(place)
                # a document's ids begin where its first word's do
                ends = pc.subtract(some.offsets, some.offsets[0])
                if counts:
                    sums = np.concatenate([[0], np.cumsum(mine.to_numpy())])[ends.to_numpy()]
                    done = pa.array(np.diff(sums), pa.int32())
                else:
                    done = pa.ListArray.from_arrays(mine.offsets.take(ends), mine.values)
                out.append(pa.RecordBatch.from_arrays([keys.slice(at, 512), done], ["key", "out"]))
        return pa.Table.from_batches(out) if out else pa.table({"key": texts.column("key"), "out": pa.array([], pa.int32() if counts else pa.list_(pa.int32()))})

    usual = placed.groupBy("block").cogroup(coded.groupBy("home")).applyInArrow(put, f"key {kind}, out {wanted}")
    rare = base.where(strange).mapInArrow(_encode_with(path), f"key {kind}, text string, ids array<int>")
    return usual.unionAll(rare.select("key", F.size("ids") if counts else F.col("ids")))


def pieces(spark: SparkSession, path: str = f"{VOCABULARIES}/{PIECES}") -> DataFrame:
    """``id, piece``: the bytes that each id stands for."""
    line = F.split("value", " ")
    return spark.read.text(path).select(line[1].cast("int").alias("id"), F.unbase64(line[0]).alias("piece"))


def decode_ids(encoded: DataFrame, table: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``key, text`` of lists of ids, by a join of ids and pieces; keys must be unique.  An empty list gives an empty text, an unknown id nothing.

    The table of pieces is the tokenizer's, of fixed size, and so is sent to all tasks."""
    each = encoded.select(key, F.posexplode_outer("ids").alias("pos", "id")).join(F.broadcast(table), "id", "left")
    whole = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return whole.select(key, F.decode(F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x["piece"], F.lit(b"")))), "UTF-8").alias("text"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{d}/documents.parquet"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return decode_ids(p6_ids(spark, d), pieces(spark))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
ORACLE = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
