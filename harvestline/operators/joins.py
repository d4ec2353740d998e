"""Joins of the procure-to-pay views.

Dimensions are not forced into a broadcast: their size is not bounded by anything in the
model. The planner broadcasts a side when its measured size is under
`spark.sql.autoBroadcastJoinThreshold`, and otherwise shuffles and splits skewed keys.
Only literal tables passed as Python rows are broadcast, up to `LITERAL_ROWS`.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.functions import numbers, status, timing
from harvestline.operators import aggregates, latest

LINE = aggregates.LINE
LITERAL_ROWS = 10_000


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Literal rows as a table, marked for broadcast while they are few."""
    table = spark.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= LITERAL_ROWS else table


def join_dim_left(facts: DataFrame, dim: DataFrame, key: str,
                  columns: Sequence[str]) -> DataFrame:
    """Facts with chosen dimension columns; unmatched facts stay."""
    return facts.join(dim.select(key, *columns), key, "left")


def join_composite_left(lines: DataFrame, receipts: DataFrame) -> DataFrame:
    """Order lines with their net receipts on (po_number, po_item)."""
    return lines.join(aggregates.receipts_sum(receipts), LINE, "left")


def join_supplier_left(lines: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Order lines with supplier name and tier."""
    return lines.join(
        suppliers.select("supplier_id", "supplier_name", F.col("tier").alias("supplier_tier")),
        "supplier_id", "left",
    )


BAND_SCHEMA = ("sensor_type string, alert_min double, alert_max double, warn_min double, "
               "warn_max double, disp_min double, disp_max double")


def join_thresholds(readings: DataFrame, bands: Sequence[tuple]) -> DataFrame:
    """Readings with the literal bands of their sensor type and the resulting status."""
    table = inline_table(readings.sparkSession, bands, BAND_SCHEMA)
    return readings.join(table, "sensor_type", "left").withColumn(
        "status",
        status.sensor_status(*[F.col(c) for c in
                               ("value", "alert_min", "alert_max", "warn_min", "warn_max")]),
    )


def newest_orders(orders: DataFrame, ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """What matching needs of the newest order event per line."""
    return latest.latest_per_key(orders, LINE, ties=ties).select(
        *LINE, F.col("net_value_usd").alias("po_net_value_usd"),
        F.col("quantity_g").alias("po_quantity_g"),
        F.col("event_type").alias("po_event_type"), "sku",
    )


def line_state(orders: DataFrame, receipts: DataFrame,
               ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Newest order event and net receipts per line, whichever exist.

    Both sides are unique per line, so this full join cannot skew, and later joins see
    one right-hand table.
    """
    return newest_orders(orders, ties).join(aggregates.receipts_sum(receipts, "gr_qty_g"), LINE, "full")


def match_lines(invoices: DataFrame, orders: DataFrame, receipts: DataFrame,
                ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """`three_way_match` with `line_state`, without a table of all lines.

    A full join keeps no partitioning, so its rows would be shuffled once more; two left joins on one
    key shuffle every side once. A skewed key is split in each of them.
    """
    return match_received(invoices, orders, aggregates.receipts_sum(receipts, "gr_qty_g"), ties)


def match_received(invoices: DataFrame, orders: DataFrame, received: DataFrame,
                   ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """`match_lines` with the net receipts per line (`gr_qty_g`)."""
    return _judged(invoices.join(newest_orders(orders, ties), LINE, "left").join(received, LINE, "left"))


def three_way_match(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices against order value and receipts. One join: invoices that all point at
    the same missing order split as a skewed key."""
    return _judged(invoices.join(lines, LINE, "left"))


def _judged(matched: DataFrame) -> DataFrame:
    return matched.withColumn("gr_qty_g", F.coalesce("gr_qty_g", F.lit(0.0))).withColumn(
        "match_status",
        status.match_status(F.col("po_net_value_usd"), F.col("gr_qty_g"), F.col("variance_usd")),
    )


def map_join_left(skus: DataFrame, crop_inputs: Sequence[tuple]) -> DataFrame:
    """SKUs with the grow input of their crop."""
    table = inline_table(skus.sparkSession, crop_inputs, "crop_type string, input_key string")
    return skus.join(table, "crop_type", "left")


def trend_fanout(prices: DataFrame, sku_inputs: DataFrame) -> DataFrame:
    """Price trend of each SKU's input: one input serves many SKUs.

    The hot side is the SKU list; it is the streamed side, prices are one row per input.
    """
    trend = prices.select("input_key", F.col("pct_24h").alias("input_pct_24h"))
    return sku_inputs.select("sku", "input_key").join(trend, "input_key").select(
        "sku", "input_pct_24h")


def feature_join(quotes: DataFrame, suppliers: DataFrame, demand: DataFrame,
                 trend: DataFrame) -> DataFrame:
    """Quotes with supplier facts, demand and input trend.

    Demand and trend are both one row per SKU; joined to each other first, the quotes
    need a single shuffle by SKU and a hot SKU can be split.
    """
    per_sku = demand.join(trend, "sku", "full")
    return quotes.join(suppliers, "supplier_id", "left").join(per_sku, "sku", "left")


def low_stock_best(low: DataFrame, trend: DataFrame, best: DataFrame) -> DataFrame:
    """Low stock with its input trend and its best supplier; stock without either stays."""
    per_sku = trend.join(best, "sku", "full")
    return low.join(per_sku, "sku", "left")


def thread_rfq_join(replies: DataFrame, outbox: DataFrame) -> DataFrame:
    """Replies with the request that opened their thread (a thread may have several)."""
    requests = outbox.where("intent = 'RFQ'").select(
        "thread_id", F.col("sku").alias("out_sku"), F.col("supplier_id").alias("out_supplier"),
        F.col("email_id").alias("rfq_email_id"))
    return replies.join(requests, "thread_id")


def without_recent_rfq(recommendations: DataFrame, outbox: DataFrame, as_of: datetime,
                       supplier: str = "recommended_supplier_id") -> DataFrame:
    """Rows with no request to the same supplier for the same SKU in the last day."""
    sent = outbox.where(
        (F.col("intent") == "RFQ") & timing.since(outbox, "created_ts", as_of, strict=True, days=1)
    ).select("sku", F.col("supplier_id").alias(supplier))
    return recommendations.join(sent, ["sku", supplier], "left_anti")


def without(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not occur in `existing`."""
    return rows.join(existing.select(key), key, "left_anti")


def having(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in `existing`."""
    return rows.join(existing.select(key), key, "left_semi")


def latest_recommendation(rows: DataFrame, recommendations: DataFrame,
                          sku: str = "sku") -> DataFrame:
    """Rows with grams and packs of the newest recommendation for their SKU."""
    newest = latest.latest_per_key(
        recommendations.select("sku", "created_ts", "recommendation_id", "reorder_grams", "packs"),
        ["sku"], "created_ts", ["recommendation_id"],
    ).select(F.col("sku").alias(sku), F.col("reorder_grams").alias("rec_grams"),
             F.col("packs").alias("rec_packs"))
    return rows.join(newest, sku, "left")


def invoice_vs_order(invoices: DataFrame, drafts: DataFrame) -> DataFrame:
    """Invoices with order total, variance, percentage and status."""
    joined = invoices.join(
        drafts.select("po_id", F.col("total_cost_usd").alias("expected_total")), "po_id", "left")
    billed, total = F.col("invoiced_amount_usd"), F.col("expected_total")
    return joined.select(
        *[c for c in joined.columns if c != "expected_total"],
        total.alias("expected_amount_usd"),
        numbers.invoice_variance(billed, total).alias("variance_usd"),
        numbers.invoice_variance_pct(billed, total).alias("variance_pct"),
    ).withColumn("status", status.reconcile_status(
        F.col("variance_pct"), numbers.has_total(F.col("expected_amount_usd"))))
