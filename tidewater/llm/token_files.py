"""Token-id files: Parquet with list columns, for selective token and metadata reads.

Format, one directory: files in ascending id order (range partitioned, sorted
within), columns part, doc_id, start (tokens before this document within the
part), n_tokens, ids array<int>.  Ids are dictionary-encoded (a vocabulary's
ids fit the dictionary page), the ascending id and start columns
delta-encoded (writer version 2), row groups of ROW_GROUP bytes, pages of
PAGE_ROWS rows with a page index; so a reader of a few documents or of
metadata alone skips the other pages and columns.

write_tokens() costs one range shuffle of the texts and encodes within the
sorted partitions; a part's token sum is a metadata read, and only one row per
part is ever gathered to turn part offsets into global ones.

Defined results: null text counts as empty (its only id is the end id, if any);
rows repeated with the same id stay together, ordered by text; null ids come
first; an empty table writes an empty directory of the same schema.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import id_text, scratch_path, table
from tidewater.llm.encoding import encoder, slices

ROW_GROUP = 32 << 20
PAGE_ROWS = 1024
SCHEMA = "part int, doc_id long, start long, n_tokens long, ids array<int>"
NAMES = ["part", "doc_id", "start", "n_tokens", "ids"]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text's ids."""
    if end_id is None:
        return ids, counts
    return np.insert(ids, np.cumsum(counts), np.uint32(end_id)), counts + 1


def _encode(tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, counts = with_end(*own.encode(texts), end_id)
                reach = np.concatenate([[0], np.cumsum(counts)])
                column = pa.ListArray.from_arrays(pa.array(reach, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), part, np.int32)), batch.column(0).slice(at, len(counts)), pa.array(before + reach[:-1]), pa.array(counts), column], NAMES)
                before += int(reach[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_text(docs, id_col, text_col).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encode(tokenizer, end_id), SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#start", "false")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, doc_id, start (over the whole corpus), n_tokens, ids."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # reads two columns
    # one row for each part, so the window and the broadcast hold as many rows as there are files
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("part", "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def crc_of_lists(column: pa.ListArray) -> list[int]:
    """crc32 of each list's values as little-endian 32-bit integers."""
    offsets = column.offsets.to_numpy()
    raw = memoryview(column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc_of_lists(batch.column(3)), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
