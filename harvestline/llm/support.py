"""Helpers the training-data operators share: tables, scratch, streams of groups, components."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.session import scratch_path

# One Arrow batch handed to Python holds at most so many rows and bytes.
ROWS_PER_BATCH = 20_000
BYTES_PER_BATCH = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of texts or numbers holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)


class Scratch:
    """Tables one operator writes below the shared checkpoint folder and drops when used up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = scratch_path(spark, label)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return it as read back: lineage ends here, on shared storage."""
        df.write.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables nothing reads any more."""
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            folder.getFileSystem(conf).delete(folder, True)

    def release(self) -> None:
        """Have Spark remove the shuffle files of finished steps that nothing refers to.

        It learns of them from the driver's garbage collector, which otherwise runs too
        seldom: the second collection finds what the first one's cleaning let go.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def long_array(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str],
                 rows: int = 100_000) -> Iterator[pa.Table]:
    """Regroup sorted batches into tables that never cut a group of equal keys.

    At most `rows` rows and one group are held at a time.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        joined = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(joined.num_rows, bool)
        for key in keys:
            column = joined[key].to_numpy()
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield joined.slice(0, cut)
        rest = joined.slice(cut)
        held, size = rest.to_batches(), 0 if cut else rest.num_rows - rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Row numbers at which a group of equal keys begins in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)


def split_cells(cells: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """Give every cell of more than `limit` rows a grid of chunk pairs.

    Adds `chunk`, `lo` and `hi`. Each row of a large cell is copied to all chunk pairs its
    chunk takes part in, so any two rows of a cell meet in exactly the pair of their chunks
    and no task holds more than two chunks of a cell.
    """
    large = (cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
             .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_chunks")))
    chunk = F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.coalesce("_chunks", F.lit(1)).cast("long"))
    return (cells.join(large, keys, "left")
            .withColumn("chunk", chunk.cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)))
            .withColumn("lo", F.least("chunk", "_other")).withColumn("hi", F.greatest("chunk", "_other"))
            .drop("_chunks", "_other"))


def connected_components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component) of every node on an edge (a, b); the component is its least node.

    Large-star and small-star rounds on tables: in each, nodes hand their neighbours to the
    least node they know. Rounds grow with the logarithm of the longest chain. Neighbour
    minima are partial aggregates and joins can be split, so a hub does not burden one task.
    """
    current = scratch.write(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{label}-0")

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)),
                            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = signature(current)
    step = 0
    while seen[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a")
                 .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        step += 1
        current = scratch.write(small, f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
        now = signature(current)
        if now == seen:
            break
        seen = now
    return (current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
