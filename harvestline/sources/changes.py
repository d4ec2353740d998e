"""Change sets between two snapshots, and keyed targets that take them.

A snapshot is compared with its predecessor by a digest per key, so that only keys and digests are
shuffled; whole rows move for changed keys alone. A target is a versioned table: each sync writes
the inserted and updated rows and a mark for each deleted key, never an unchanged row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.functions import text
from harvestline.operators import quality
from harvestline.session import cut_lineage
from harvestline.streaming.versions import COMPACT_EVERY, VersionedTable, last_version

INSERT, UPDATE, DELETE = "insert", "update", "delete"
OP = "_op"


def _digest(columns: Sequence[str]) -> Column:
    """128 bits of a digest of these columns, as bytes: half of what their text takes in a shuffle."""
    return F.unhex(F.right(text.stable_id("ROW", *[F.col(c) for c in columns]), F.lit(32)))


def _digests(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Keys of a snapshot and one digest of all its other columns."""
    return df.select(*[F.col(k).alias(f"{side}_{k}") for k in keys],
                     _digest([c for c in df.columns if c not in keys]).alias(f"{side}_digest"))


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    return reduce(and_, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys])


def change_set(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that turn `old` into `new`: its columns and `_op` (insert, update, delete).

    Both have one row per key. A deleted row carries its key, other columns are NULL.
    """
    return _changes(_digests(old, keys, "old"), new, keys)


def _changes(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The change set against an old snapshot of which keys and digests are left."""
    both = old.join(_digests(new, keys, "new"), _same(keys, "old_", "new_"), "full")
    op = (F.when(F.col("old_digest").isNull(), INSERT).when(F.col("new_digest").isNull(), DELETE)
          .when(F.col("old_digest") != F.col("new_digest"), UPDATE))
    changed = cut_lineage(both.select(op.alias(OP), *[F.coalesce(f"new_{k}", f"old_{k}").alias(f"at_{k}") for k in keys])
                          .where(F.col(OP).isNotNull()), "changes")
    rest = [c for c in new.columns if c not in keys]
    written = new.join(changed.where(F.col(OP) != DELETE), _same(keys, "", "at_")).select(*new.columns, OP)
    gone = changed.where(F.col(OP) == DELETE).select(
        *[F.col(f"at_{k}").alias(k) for k in keys], *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in rest], OP)
    return written.unionByName(gone)


class Mirror:
    """A keyed copy of a view that is brought up to date by change sets."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], every: int = COMPACT_EVERY):
        self.keys = list(keys)
        self.table = VersionedTable(spark, path, last_version(keys), every)

    def read(self) -> DataFrame | None:
        """The mirrored rows, None before the first sync."""
        rows = self.table.read()
        return None if rows is None else rows.where(F.col(OP) != DELETE).drop(OP)

    def _known(self, columns: Sequence[str]) -> DataFrame | None:
        """Keys and digests of the mirrored rows; whole rows are not folded for it."""
        rest = [c for c in columns if c not in self.keys]
        rows = self.table.read(shape=lambda rows: rows.select(*self.keys, "batch_id", OP, _digest(rest).alias("old_digest")))
        return None if rows is None else rows.where(F.col(OP) != DELETE).select(
            *[F.col(k).alias(f"old_{k}") for k in self.keys], "old_digest")

    def sync(self, view: DataFrame) -> dict[str, int]:
        """Apply what changed since the last sync; the number of changes by kind.

        A view that repeats a key is refused before anything is written.
        """
        staged = cut_lineage(view, "mirror")
        quality.assert_unique(staged, self.keys, self.table.path)
        known = self._known(staged.columns)
        if known is None:
            changes = staged.withColumn(OP, F.lit(INSERT))
        else:
            changes = _changes(known, staged, self.keys)
        last = max([*self.table.deltas(), -1 if self.table.base() is None else self.table.base()], default=-1)
        self.table.write(changes, last + 1)
        written = self.table.spark.read.parquet(f"{self.table.path}/batch_id={last + 1}")
        return {r[OP]: r["count"] for r in written.groupBy(OP).count().collect()}
