"""Token ids of whole documents as Parquet files that allow selective reads.

Rows are range-partitioned and sorted by doc_id, so files and row groups cover ascending id
ranges. `ids` is a list column with dictionary pages; doc_id, shard_start and n_tokens use
delta encoding (format v2 without a dictionary). Row groups and pages are bounded and
carry column and offset indexes: a read of `n_tokens` touches no id page, and a filter on
doc_id skips row groups and pages.

Defined cases: null text is empty and yields only the end id; rows with a null doc_id come
first; rows that share a doc_id are ordered by text, nulls first, and split like any others if their texts
begin differently; repeated
rows are written as often as they occur; no rows give no files with rows. Only doc_id and text
are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestline.llm import tokens
from harvestline.llm.support import Scratch, bound_batches, long_array, table

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"
ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
END_ID = 0
KEY_CHARS = 16           # characters of a text that tell ranges of one doc_id apart


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    shard, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, ends = tokens.encoder(path).encode_column(batch["text"])
        ids = np.insert(ids, ends, end_id).view(np.int32)
        ends = ends + np.arange(1, len(ends) + 1)
        before = np.r_[0, ends[:-1]] if len(ends) else ends
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids))
        yield pa.record_batch([batch["doc_id"], pa.array(np.full(len(ends), shard, np.int32)),
                               pa.array(start + before, pa.int64()), pa.array((ends - before).astype(np.int32)), lists],
                              names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])
        start += int(ends[-1]) if len(ends) else 0


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int = END_ID) -> None:
    """Encode `text` of every document, append `end_id`, write in ascending doc_id order."""
    bound_batches(docs.sparkSession)
    # range bounds are sampled keys on the driver: of a text they take its beginning only
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .repartitionByRange("doc_id", F.left("text", F.lit(KEY_CHARS))).sortWithinPartitions("doc_id", "text"))
    encoded = rows.mapInArrow(lambda batches: _encode(batches, path, end_id), SCHEMA)
    (encoded.write.option("parquet.block.size", ROW_GROUP_BYTES)
     .option("parquet.page.size", PAGE_BYTES)
     .option("parquet.page.row.count.limit", 20_000)
     .option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#shard_start", "false")
     .option("parquet.enable.dictionary#n_tokens", "false")
     .option("compression", "zstd").parquet(target))


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """The files with `start`: the number of ids before each document over all files.

    Shard totals come from the metadata columns alone. They are one row of two numbers per
    file written, so the running sum and the broadcast are bounded by the number of files.
    """
    files = spark.read.schema(SCHEMA).parquet(target)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n")).select(
        "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (files.join(F.broadcast(bases), "shard")
            .withColumn("start", F.col("_base") + F.col("shard_start")).drop("_base"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        flat = memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B")
        at = ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.record_batch([batch["doc_id"], batch["start"], pa.array(long_array(batch["n_tokens"])),
                               pa.array(crc, pa.int64())],
                              names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids read back."""
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir):
    scratch = Scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), scratch.path("files"), tokens.default_path())
    return digest(read_tokens(spark, scratch.path("files")))
