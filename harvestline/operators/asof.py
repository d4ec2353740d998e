"""Values as of an earlier time, and changes against them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestline.functions import numbers, timing


def max_before(df: DataFrame, key: str, ts: str, as_of: datetime, **span: float) -> DataFrame:
    """Newest timestamp per key that is at least `span` old."""
    return df.where(timing.until(df, ts, as_of, **span)).groupBy(key).agg(F.max(ts).alias("ref_ts"))


def asof_value(df: DataFrame, key: str, ts: str, value: str, as_of: datetime, *,
               ties: Sequence[str] = ("event_id",), name: str = "ref_value",
               **span: float) -> DataFrame:
    """Per key the value of its newest row at least `span` old.

    One aggregate with a map-side combine; no self-join, one row per key even on ties.
    """
    old = df.where(timing.until(df, ts, as_of, **span))
    return old.groupBy(key).agg(F.max_by(value, F.struct(ts, *ties)).alias(name))


def asof_multi(df: DataFrame, key: str, ts: str, value: str, as_of: datetime,
               horizons: Sequence[int], keep: Sequence[str] = (), *,
               ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Newest row per key plus the value at each horizon (hours back), from one pass.

    The newest row is the newest of all rows, also ones after `as_of`.
    """
    order = F.struct(ts, *ties)
    newest = F.max_by(F.struct(value, *keep, ts), order).alias("_now")
    back = [
        F.max_by(F.when(timing.until(df, ts, as_of, hours=h), F.col(value)),
                 F.when(timing.until(df, ts, as_of, hours=h), order)).alias(f"value_{h}h")
        for h in horizons
    ]
    return df.groupBy(key).agg(newest, *back).select(
        key, "_now.*", *[f"value_{h}h" for h in horizons])


def _micros(df: DataFrame, ts: str) -> Column:
    column = F.col(ts)
    if not isinstance(df.schema[ts].dataType, T.TimestampType):
        column = column.cast("timestamp")
    return F.unix_micros(column)


# Rows that one (key, bucket) of `asof_each_row` should hold at most.
BUCKET_ROWS = 1_000_000
_HOUR = timedelta(hours=1)


def bucket_width(df: DataFrame, key: str, ts: str, rows: int = BUCKET_ROWS) -> timedelta:
    """Bucket width at which the densest hour of the densest key gives about `rows` rows
    per bucket. One counting pass over two columns; one number reaches the driver."""
    hour = F.floor(_micros(df, ts) / int(_HOUR / timedelta(microseconds=1)))
    densest = df.groupBy(key, hour.alias("_hour")).count().agg(F.max("count")).first()[0]
    width = _HOUR * (rows / (densest or 1))
    return min(max(width, timedelta(milliseconds=1)), timedelta(days=365))


# Buckets of one key that one task carries values through.
SPAN = 10_000


def _carried(closing: DataFrame, key: str) -> DataFrame:
    """For each (key, bucket) the last close before it, NULL keys included.

    Spans of buckets close first; a span opens with what the spans before it closed with.
    """
    spans = closing.withColumn("_span", F.floor(F.col("_slot") / SPAN))
    span_close = spans.groupBy(key, "_span").agg(
        F.max_by("_close", F.when(F.col("_close").isNotNull(), F.col("_slot"))).alias("_close"))
    earlier = W.partitionBy(key).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    opened = span_close.select(
        key, (F.col("_span") * SPAN - 1).alias("_slot"),
        F.last("_close", ignorenulls=True).over(earlier).alias("_close"), "_span",
        F.lit(True).alias("_open"))
    before = W.partitionBy(key, "_span").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return (
        spans.withColumn("_open", F.lit(False)).unionByName(opened)
        .withColumn("_value", F.last("_close", ignorenulls=True).over(before))
        .where("NOT _open").select(key, "_slot", "_value")
    )


def asof_each_row(df: DataFrame, key: str, ts: str, value: str, horizon: timedelta, *,
                  ties: Sequence[str] = ("event_id",), bucket: timedelta | None = None,
                  name: str = "ref_value") -> DataFrame:
    """For every row, the value its key had `horizon` earlier.

    A window over the key alone would put a hot key into one task. Time is cut into
    buckets: each row appears once as a candidate (at its time) and once as a question
    (at its time less `horizon`), and a window inside (key, bucket) answers the question.
    What was valid when a bucket opened comes from a small table of the last candidate
    per bucket, carried forward in spans of buckets. The result does not depend on
    `bucket`; by default it follows the density of the feed. NULL is a key of its own.
    """
    width = int((bucket or bucket_width(df, key, ts)) / timedelta(microseconds=1))
    shift = int(horizon / timedelta(microseconds=1))
    at = _micros(df, ts)
    tie_order = F.struct(*[F.col(t) for t in ties])
    held = F.struct(F.col(value).alias("v"))
    no_tie, no_value, no_row = (
        F.lit(None).cast(df.select(c.alias("x")).schema["x"].dataType)
        for c in (tie_order, held, F.struct(*[F.col(c) for c in df.columns])))
    slot = F.floor(F.col("_at") / width).alias("_slot")

    candidate = F.struct(at.alias("_at"), tie_order.alias("_tie"), F.lit(0).alias("_kind"),
                         held.alias("_value"), no_row.alias("_row"))
    question = F.struct((at - shift).alias("_at"), no_tie.alias("_tie"), F.lit(1).alias("_kind"),
                        no_value.alias("_value"),
                        F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    events = df.select(F.col(key), F.explode(F.array(candidate, question)).alias("_e")).select(
        key, "_e.*").select("*", slot)

    # what each bucket closes with; a bucket that is only asked closes with nothing
    closing = events.groupBy(key, "_slot").agg(
        F.max_by("_value", F.when(F.col("_kind") == 0, F.struct("_at", "_tie"))).alias("_close"))
    opening = (
        _carried(closing, key).where(F.col("_value").isNotNull())
        .select(key, (F.col("_slot") * width).alias("_at"), no_tie.alias("_tie"),
                F.lit(-1).alias("_kind"), "_value", no_row.alias("_row"), "_slot")
    )
    timeline = events.unionByName(opening)
    inside = (
        W.partitionBy(key, "_slot")
        .orderBy("_at", "_kind", "_tie")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    # a carried-in value stands before every candidate of its bucket, a question after
    # the candidates of its own instant
    return (
        timeline.withColumn("_ref", F.last("_value", ignorenulls=True).over(inside))
        .where(F.col("_kind") == 1)
        .select("_row.*", F.col("_ref.v").alias(name))
    )


def asof_change(df: DataFrame, key: str, ts: str, value: str, horizon: timedelta,
                **options) -> DataFrame:
    """`asof_each_row` plus the relative change `pct`."""
    found = asof_each_row(df, key, ts, value, horizon, **options)
    return found.withColumn("pct", numbers.pct_change(F.col(value), F.col("ref_value")))


def pct_vs_baseline(df: DataFrame, key: str, ts: str, value: str, *,
                    ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Percent change of each sample against the first non-zero value of its key.

    The baseline is an aggregate joined back, so a long series is never sorted whole.
    """
    first = df.where(F.col(value) != 0).groupBy(key).agg(
        F.min_by(value, F.struct(ts, *ties)).alias("baseline"))
    return df.join(first, key, "left").withColumn(
        "pct_vs_base", numbers.pct_change(F.col(value), F.col("baseline")) * 100.0)
