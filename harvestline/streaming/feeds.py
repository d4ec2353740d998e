"""Validated feeds as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from harvestline.session import scratch_ends_here
from harvestline.operators.quality import dedup_event_id
from harvestline.plans import silver
from harvestline.sources.readers import with_instants


def stream_dedup(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per event id over the whole stream.

    The state keeps every id ever seen and so grows without end; it is the exact form.
    """
    return dedup_event_id(events, key)


def stream_dedup_bounded(events: DataFrame, ts: str = "event_ts", lateness: str = "1 day",
                         key: str = "event_id") -> DataFrame:
    """One row per event id among copies that arrive within `lateness` of each other.

    The state holds `lateness` worth of ids. A row older than the watermark is dropped.
    """
    return (
        with_instants(events).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])
    )


def stream_silver(feed: str, events: DataFrame, lateness: str | None = None,
                  ts: str = "event_ts") -> DataFrame:
    """Rules, duplicate removal and derived columns on a stream.

    Without `lateness` duplicates are recognised however late they come; with it the
    state is bounded, see `stream_dedup_bounded`.
    """
    kept = silver.validated(feed, events)
    return stream_dedup(kept) if lateness is None else stream_dedup_bounded(kept, ts, lateness)


def append_to(df: DataFrame, path: str, checkpoint: str, *,
              every: str | None = None) -> StreamingQuery:
    """Append a stream to a parquet table; exactly once per row by the file sink's log.

    `every` sets a processing-time trigger; without it all available input is taken and
    the query ends.
    """
    writer = df.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", checkpoint)
    return _trigger(writer, every).start(path)


def for_each_batch(df: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, *,
                   mode: str = "append", every: str | None = None) -> StreamingQuery:
    """Hand every micro-batch to `apply(batch, batch_id)`; its scratch goes when it returns."""
    def call(batch: DataFrame, batch_id: int) -> None:
        with scratch_ends_here(batch.sparkSession):
            apply(batch, batch_id)

    writer = df.writeStream.outputMode(mode).foreachBatch(call).option(
        "checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
