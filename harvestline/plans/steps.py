"""What the steps of a job made, kept so that a job that was cut off goes on where it stopped.

A log is one folder per job run on storage that all executors reach. A step writes its table and is
committed by a marker file, created in one atomic step of the file system. A table without its marker
is what a crash left behind: it is written anew. One driver runs a job at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class StepLog:
    """Tables of committed steps below `folder`/`run`."""

    def __init__(self, spark: SparkSession, folder: str, run: str):
        if not run or "/" in run or run.startswith("."):
            raise ValueError(f"not a name of a run: {run!r}")
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{run}"

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> set[str]:
        """Names of the steps that are done."""
        folder, files = self._at("_done")
        return {s.getPath().getName() for s in files.listStatus(folder)} if files.exists(folder) else set()

    def once(self, step: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a step; built, written and committed only if no run before did."""
        if step not in self.committed():
            return self.again(step, build())
        return self.table(step)

    def table(self, step: str) -> DataFrame:
        """The table of a step that is done."""
        return self.spark.read.parquet(f"{self.path}/{step}")

    def again(self, step: str, built: DataFrame) -> DataFrame:
        """Write the table of a step anew and commit it, whatever a run before left."""
        marker, files = self._at(f"_done/{step}")
        built.write.mode("overwrite").parquet(f"{self.path}/{step}")
        files.mkdirs(marker.getParent())
        files.createNewFile(marker)
        return self.table(step)

    def empty(self, step: str) -> None:
        """Delete the table of a step that no later step reads. It stays committed."""
        folder, files = self._at(step)
        files.delete(folder, True)

    def forget(self) -> None:
        """Delete the log, when the results have been applied."""
        folder, files = self._at("")
        files.delete(folder, True)
