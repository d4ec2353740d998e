"""Writing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from harvestline.operators import quality
from harvestline.session import cut_lineage


def append_sink(df: DataFrame, path: str, fmt: str = "parquet", *,
                partition_by: Sequence[str] = ()) -> None:
    """Append rows to an event or state table."""
    writer = df.write.format(fmt).mode("append")
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def materialise(df: DataFrame, path: str, *, partition_by: Sequence[str] = (),
                options: Mapping[str, str] | None = None) -> DataFrame:
    """Write a derived table and return it as read back."""
    writer = df.write.mode("overwrite").options(**dict(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, name: str, path: str, buckets: int,
             keys: Sequence[str]) -> DataFrame:
    """Write a catalogue table bucketed by `keys`.

    Tables bucketed alike join and aggregate on these keys without a shuffle: order
    events and receipts bucketed by order line feed both order views that way. Choose
    `buckets` so that one bucket of the largest table fits a task.
    """
    (df.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys)
     .sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


def snapshot_sync(df: DataFrame, target: str, primary_keys: Sequence[str], *,
                  fmt: str = "parquet", options: Mapping[str, str] | None = None) -> DataFrame:
    """Full refresh of a serving target with a declared primary key.

    The rows are written once to scratch; the key check reads only the key columns from
    there, and a snapshot that breaks its key never reaches the target. `fmt="jdbc"` with
    connection options takes the same path.
    """
    staged = cut_lineage(df, "snapshot")
    quality.assert_unique(staged, primary_keys, target)
    writer = staged.write.format(fmt).options(**dict(options or {})).mode("overwrite")
    if fmt == "jdbc":
        writer.option("dbtable", target).save()
    else:
        writer.save(target)
    return staged


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch below its own id: a replayed batch overwrites itself."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def drop_delivered(spark: SparkSession, path: str) -> None:
    """Delete the files of a folder whose rows all streams over it have committed. The folder stays."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        files.delete(status.getPath(), True)
