"""Grouped totals. All are partial-then-final aggregates, so hot keys combine map-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.functions import timing
from harvestline.operators import latest, quality

LINE = ["po_number", "po_item"]


def receipts_sum(receipts: DataFrame, name: str = "qty_received_g") -> DataFrame:
    """Net grams received per order line; reversals are negative and cancel out."""
    return receipts.groupBy(*LINE).agg(F.sum("qty_received_g").alias(name))


def demand_tumbling(demand: DataFrame, width: str = "1 hour") -> DataFrame:
    """Trays and grams per SKU and tumbling hour. Works on batch and stream alike."""
    return (
        demand.groupBy("sku", F.window("event_ts", width).alias("slot"))
        .agg(F.sum("trays").alias("trays"), F.sum("grams_req").alias("grams_req"))
        .select("sku", F.col("slot.start").alias("hour_ts"), "trays", "grams_req")
    )


def demand_total(hourly: DataFrame, as_of: datetime | None = None,
                 hours: int | None = None) -> DataFrame:
    """Trays per SKU over all hours, or over the last `hours` before `as_of`."""
    if hours is not None:
        hourly = quality.lookback(hourly, "hour_ts", as_of, hours=hours)
    return hourly.groupBy("sku").agg(F.sum("trays").alias("demand_1h_trays"))


def demand_by_hour_label(hourly: DataFrame) -> DataFrame:
    """Trays per hour-of-day label; the same hour of two days is one bar."""
    return hourly.groupBy(F.date_format("hour_ts", "HH").alias("hour")).agg(
        F.sum("trays").alias("trays"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def count_distinct(df: DataFrame, column: str) -> DataFrame:
    """Exact totals: all rows, and distinct non-NULL values."""
    per_value = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                         F.count(column).alias("uniq"))


_SEVERITY = ["NOMINAL", "CAUTION", "ALERT"]


def room_status(sensors: DataFrame) -> DataFrame:
    """Worst status per room with alert and caution counts and the newest reading."""
    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(i)) for i, s in enumerate(_SEVERITY)])
    return (
        sensors.groupBy("room_id")
        .agg(
            F.max(rank).alias("_worst"),
            F.count_if(F.col("status") == "ALERT").alias("alerts"),
            F.count_if(F.col("status") == "CAUTION").alias("cautions"),
            F.max("event_ts").alias("last_ts"),
        )
        .withColumn("room_status", F.element_at(F.array(*[F.lit(s) for s in _SEVERITY]),
                                                F.coalesce("_worst", F.lit(0)) + 1))
        .drop("_worst")
    )


def farm_overview(sensors: DataFrame) -> DataFrame:
    """Rooms in total and by worst status."""
    status = F.col("room_status")
    return (
        room_status(sensors)
        .agg(
            F.count(F.lit(1)).alias("rooms"),
            F.count_if(status == "ALERT").alias("alert_rooms"),
            F.count_if(status == "CAUTION").alias("caution_rooms"),
        )
        .withColumn("nominal_rooms",
                    F.col("rooms") - F.col("alert_rooms") - F.col("caution_rooms"))
    )


def sparkline_stats(readings: DataFrame, n: int = 40) -> DataFrame:
    """Bounds of the newest `n` readings per room and sensor; an empty range is one."""
    keys = ["room_id", "sensor_type"]
    recent = latest.last_n_samples(readings.where("value IS NOT NULL"), keys, n)
    spread = F.col("high") - F.col("low")
    return (
        recent.groupBy(*keys)
        .agg(F.min("value").alias("low"), F.max("value").alias("high"),
             F.count(F.lit(1)).alias("samples"))
        .withColumn("spread", F.coalesce(F.nullif(spread, F.lit(0.0)), F.lit(1.0)))
    )


def unique_suppliers(leaderboard: DataFrame) -> DataFrame:
    """One row per supplier, the last one in leaderboard order, sorted by name.

    The winner's rank and SKU travel with it; only supplier columns vary by row.
    """
    pick = F.max_by(F.struct("supplier_name", "sku", "rank"), F.struct("sku", "rank"))
    return (
        leaderboard.groupBy("supplier_id").agg(pick.alias("_last"))
        .select("supplier_id", "_last.*")
        .orderBy(F.coalesce("supplier_name", F.lit("")), "supplier_id")
    )


def global_mean_norm(df: DataFrame, column: str, name: str) -> DataFrame:
    """Value relative to the mean of the whole table (a scalar subquery)."""
    return df.withColumn(name, F.try_divide(F.col(column), df.agg(F.avg(column)).scalar()))


def mean_absolute_error(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(prediction) - F.col(label))).alias("mae"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table, one row per table."""
    parts: list[DataFrame] = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def kpi_summary(inventory: DataFrame, recommendations: DataFrame, prices: DataFrame,
                drafts: DataFrame, inbox: DataFrame, as_of: datetime) -> DataFrame:
    """Dashboard row. Independent aggregates combined as scalar subqueries; the two facts
    about recommendations share one pass."""

    def scalar(df: DataFrame, value: Column) -> Column:
        return df.agg(value).scalar()

    rows = F.count(F.lit(1))
    fresh = timing.since(recommendations, "created_ts", as_of, strict=True, minutes=5)
    hour = timing.since(recommendations, "created_ts", as_of, strict=True, hours=1)
    spend = F.sum(F.when(hour, F.col("total_cost_usd")))
    urgent = scalar(recommendations.where(hour | fresh), F.struct(
        F.count_if(fresh & (F.col("decision") == "BUY_NOW")).alias("n"),
        F.coalesce(spend, F.lit(0.0)).alias("usd")))
    low = quality.below_reorder(inventory).agg(rows.alias("skus_below_reorder"))
    return low.select(
        "skus_below_reorder",
        urgent["n"].alias("buy_now_last_5m"),
        urgent["usd"].alias("spend_pending_1h_usd"),
        scalar(prices, F.max("event_ts")).alias("last_market_tick"),
        scalar(drafts.where("status = 'DRAFT'"), rows).alias("po_drafts_open"),
        scalar(quality.unprocessed(inbox), rows).alias("inbound_unprocessed"),
    )


def multi_key_sort(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(*keys)
