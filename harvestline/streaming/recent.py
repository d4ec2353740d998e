"""The newest n rows of each key, kept while a feed moves.

The newest n of a union are the newest n of the newest n of its parts. So each micro-batch is cut to
n rows per key before its shuffle and written as a delta; compaction and readers merge deltas by the
same cut. Neither the split into batches nor the order of arrival changes the result, and a key holds
at most n rows in the base, whatever share of the feed it has. Late rows count if they belong to the
newest n.

Statistics over the samples, such as the bounds of a sparkline, are aggregates over what is kept and
so the same functions as in a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from harvestline.operators import latest
from harvestline.streaming.feeds import for_each_batch
from harvestline.streaming.versions import COMPACT_EVERY, Fold, VersionedTable


def newest_n(keys: Sequence[str], n: int, ts: str = "event_ts", ties: Sequence[str] = ("event_id",)) -> Fold:
    """Fold to the newest `n` rows per key."""
    return lambda rows: latest.last_n_samples(rows, keys, n, ts, ties)


class RecentSamples:
    """A stored table of the newest `n` rows per key, ordered by (`ts`, `ties`)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], n: int, *, ts: str = "event_ts",
                 ties: Sequence[str] = ("event_id",), every: int = COMPACT_EVERY):
        if n < 1:
            raise ValueError("n counts the rows to keep, at least one")
        self.fold = newest_n(keys, n, ts, ties)
        self.table = VersionedTable(spark, path, self.fold, every)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Merge one batch; the same batch again replaces what it wrote."""
        self.table.write(self.fold(rows), batch_id)

    def read(self, only: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame | None:
        """The samples, of the keys in `only` if given; None before the first batch."""
        return self.table.read(only, on)

    def follow(self, events: DataFrame, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
        """Keep the samples of a feed without copies (`stream_silver`) current."""
        return for_each_batch(events, self.add, checkpoint, every=every)
