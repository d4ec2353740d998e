"""Tables written batch by batch, with compaction.

Each micro-batch is one delta below its own id, so a replayed batch overwrites itself. From time
to time older deltas are folded into a base. A base counts from the moment a pointer file with
its last batch id is created, which is one atomic step of the file system; readers take the
highest pointer and the deltas behind it. Folders of the generation before stay until the next
compaction, for readers that still hold them.

Only batches that the stream has committed are folded: in batch n all before n. A read therefore
opens one base and at most twice `every` deltas, however many batches there were.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.operators import latest
from harvestline.sources import sinks

Fold = Callable[[DataFrame], DataFrame]
COMPACT_EVERY = 16


def newest_by(keys: Sequence[str], ts: str, ties: Sequence[str] = ("event_id",)) -> Fold:
    """Fold to the newest row per key; the batch it came in does not matter."""
    return lambda rows: latest.latest_per_key(rows, keys, ts, ties)


def last_version(keys: Sequence[str]) -> Fold:
    """Fold to the row of the last batch that has the key."""
    return lambda rows: latest.latest_per_key(rows, keys, "batch_id", ties=())


def added_up(keys: Sequence[str], *values: str) -> Fold:
    """Fold by adding signed changes."""
    return lambda rows: rows.groupBy(*keys).agg(
        *[F.sum(v).alias(v) for v in values], F.max("batch_id").alias("batch_id"))


class VersionedTable:
    """A folder of deltas and a base; `fold` makes one row per key of rows with a batch_id."""

    def __init__(self, spark: SparkSession, path: str, fold: Fold, every: int = COMPACT_EVERY):
        self.spark, self.path, self.fold, self.every = spark, path.rstrip("/"), fold, every

    def _at(self, name: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        folder, files = self._at(name)
        return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []

    def _delete(self, name: str) -> None:
        folder, files = self._at(name)
        files.delete(folder, True)

    def base(self) -> int | None:
        """Last batch of the base in force."""
        return max((int(n) for n in self._names("_current") if n.isdigit()), default=None)

    def deltas(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names("") if n.startswith("batch_id="))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write the delta of a batch; before that fold older ones if many have gathered."""
        base = self.base()
        waiting = [d for d in self.deltas() if d < batch_id and (base is None or d > base)]
        if len(waiting) >= self.every:
            self.compact(waiting[-1])
        sinks.write_batch(rows.drop("batch_id"), self.path, batch_id)

    def _rows(self, before: int | None = None) -> DataFrame | None:
        base = self.base()
        ids = [d for d in self.deltas() if (base is None or d > base) and (before is None or d < before)]
        parts = []
        if ids:
            parts.append(self.spark.read.option("basePath", self.path).parquet(
                *[f"{self.path}/batch_id={d}" for d in ids]).withColumn("batch_id", F.col("batch_id").cast("long")))
        if base is not None:
            parts.append(self.spark.read.parquet(f"{self.path}/_base/upto={base}"))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def read(self, only: DataFrame | None = None, on: Sequence[str] = (), before: int | None = None,
             shape: Fold | None = None) -> DataFrame | None:
        """One row per key, None before the first batch. `only` keeps keys it holds in `on`;
        `before` leaves out the deltas of that batch and later ones; `shape` narrows rows to what
        the reader needs before they are folded (keys and batch_id must stay)."""
        rows = self._rows(before)
        if rows is None:
            return None
        if only is not None:
            rows = rows.join(only.select(*on).distinct(), list(on), "left_semi")
        return self.fold(rows if shape is None else shape(rows)).drop("batch_id")

    def delta(self, batch_id: int) -> DataFrame:
        """What one batch wrote."""
        return self.spark.read.parquet(f"{self.path}/batch_id={batch_id}")

    def compact(self, upto: int) -> None:
        """Fold everything up to a committed batch into a new base and switch to it."""
        previous = self.base()
        rows = self._rows(before=upto + 1)
        if rows is None or previous is not None and upto <= previous:
            return
        self.fold(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/_base/upto={upto}")
        pointer, files = self._at(f"_current/{upto}")
        files.mkdirs(pointer.getParent())
        files.createNewFile(pointer)
        if previous is None:
            return
        for d in self.deltas():
            if d <= previous:
                self._delete(f"batch_id={d}")
        for name in self._names("_base"):
            if int(name.split("=")[1]) < previous:
                self._delete(f"_base/{name}")
        for name in self._names("_current"):
            if name.isdigit() and int(name) < previous:
                self._delete(f"_current/{name}")
