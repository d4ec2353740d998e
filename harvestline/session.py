"""Session settings and lineage cuts."""

from __future__ import annotations

import functools
import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every plan here relies on. Partition counts are left to the
# cluster: AQE coalesces or splits what `spark.sql.shuffle.partitions` starts with.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed side even when that costs one more shuffle further up
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a query that is done leaves no shuffle files: a job of many steps needs the disk of one
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

# Streaming state lives off-heap and is checkpointed incrementally.
STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to an existing session."""
    for key, value in {**SESSION_CONF, **STATE_STORE_CONF}.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "harvestline", cores: str = "*", memory: str = "8g",
                  shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


# folder -> thread that made it: streams run side by side in threads of their own
_SCRATCH: dict[str, int] = {}


@functools.cache
def _temporary_base() -> str:
    return tempfile.mkdtemp(prefix="harvestline-")


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """Storage that all executors reach: `folder`, else the session's checkpoint folder.

    Only where driver and executors are one process may it be a temporary local folder;
    any other master without a shared folder is refused.
    """
    context = spark.sparkContext
    known = folder or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", context.master):
        return _temporary_base()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")


def scratch_path(spark: SparkSession, label: str, folder: str | None = None) -> str:
    """A new folder below the shared folder of the cluster."""
    path = f"{shared_folder(spark, folder)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH[path] = threading.get_ident()
    return path


def _delete(spark: SparkSession, paths: Iterable[str]) -> int:
    conf = spark._jsc.hadoopConfiguration()
    dropped = 0
    for path in list(paths):
        _SCRATCH.pop(path, None)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        dropped += bool(folder.getFileSystem(conf).delete(folder, True))
    return dropped


def drop_scratch(spark: SparkSession) -> int:
    """Delete what this process put into scratch; call it when results are written.

    DataFrames built on dropped tables cannot be read afterwards.
    """
    return _delete(spark, _SCRATCH)


@contextmanager
def scratch_ends_here(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving whatever this thread put into scratch inside the block."""
    before = set(_SCRATCH)
    try:
        yield
    finally:
        own = threading.get_ident()
        _delete(spark, [p for p, t in _SCRATCH.items() if t == own and p not in before])


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write `df` to shared storage and read it back.

    Survives executor loss, and unlike an RDD checkpoint keeps column pruning and
    gives the planner real sizes.
    """
    return cut_slices([df], label)


def cut_slices(slices: Iterable[DataFrame], label: str) -> DataFrame:
    """`cut_lineage` of tables of one schema, one after the other: what one shuffles is gone when the next begins."""
    path = None
    for df in slices:
        path = path or scratch_path(df.sparkSession, label)
        df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Bytes of input, as the planner sizes it, that a job made in slices takes at a time, and the slices at most.
# The planner knows no size beyond a petabyte: there it only has a default or a product.
SLICE_BYTES, MOST_SLICES, UNKNOWN_BYTES = 4 << 30, 64, 1 << 50


def slices_for(keys: Iterable[str], *tables: DataFrame) -> int:
    """Slices by a hash of `keys` that a job over these tables needs; 1 if a key has several types."""
    if any(len({t.schema[k].dataType for t in tables}) > 1 for k in keys):
        return 1
    sizes = (int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for t in tables)
    total = sum(sizes)
    return 1 if total >= UNKNOWN_BYTES else min(max(1, -(-total // SLICE_BYTES)), MOST_SLICES)


def slice_of(df: DataFrame, keys: Iterable[str], number: int, of: int) -> DataFrame:
    """Rows of one slice; every row is in one of them, with or without a key."""
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(of)) == number)
