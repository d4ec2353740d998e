"""Parameterised reads over gold and state tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.operators import aggregates, latest, quality


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value


def q_inventory(snapshot: DataFrame, sku=None, room_id=None) -> DataFrame:
    found = quality.optional_filters(snapshot, {"sku": sku, "room_id": room_id})
    return aggregates.multi_key_sort(
        found.select("sku", "room_id", "on_hand_g", "last_event_ts", "reorder_point_g",
                     "target_stock_g"), ["sku", "room_id"])


def q_leaderboard(leaderboard: DataFrame, sku=None, top: int = 5) -> DataFrame:
    _within("top", top, 1, 20)
    found = quality.optional_filters(leaderboard, {"sku": sku}).where(F.col("rank") <= top)
    return aggregates.multi_key_sort(found, ["sku", "rank"])


def q_commodity(prices: DataFrame) -> DataFrame:
    return aggregates.multi_key_sort(
        prices.select("input_key", "price_usd", "unit", "event_ts", "pct_1h", "pct_24h"),
        ["input_key"])


def q_demand(hourly: DataFrame, as_of: datetime, sku=None, hours: int = 24) -> DataFrame:
    _within("hours", hours, 1, 168)
    recent = quality.lookback(quality.optional_filters(hourly, {"sku": sku}), "hour_ts", as_of,
                              hours=hours)
    return aggregates.multi_key_sort(recent, ["hour_ts", "sku"])


def q_recommendations(recommendations: DataFrame, decision: str | None = None,
                      limit: int = 50) -> DataFrame:
    _within("limit", limit, 1, 500)
    found = quality.optional_filters(recommendations, {"decision": decision}, ["decision"])
    return latest.newest_first(found, "created_ts", ["recommendation_id"], limit)


def q_iot(sensors: DataFrame) -> DataFrame:
    return aggregates.multi_key_sort(
        sensors.select("room_id", "sensor_type", "value", "unit", "alert_min", "alert_max",
                       "warn_min", "warn_max", "disp_min", "disp_max", "status", "event_ts"),
        ["room_id", "sensor_type"])


def q_po_lines(lines: DataFrame, status: str | None = None, supplier_id=None,
               limit: int = 100) -> DataFrame:
    _within("limit", limit, 1, 1000)
    found = quality.optional_filters(
        lines, {"po_status": status, "supplier_id": supplier_id}, ["po_status"])
    return latest.newest_first(
        found.select("po_number", "po_item", "event_type", "supplier_id", "supplier_name",
                     "supplier_tier", "sku", "quantity_g", "unit_price_usd", "net_value_usd",
                     "delivery_date_ts", "qty_received_g", "qty_outstanding_g", "po_status",
                     "event_ts"), "event_ts", ["po_number", "po_item"], limit)


def q_invoice_matching(matches: DataFrame, match_status: str | None = None,
                       limit: int = 100) -> DataFrame:
    _within("limit", limit, 1, 1000)
    found = quality.optional_filters(matches, {"match_status": match_status}, ["match_status"])
    return latest.newest_first(
        found.select("invoice_doc_number", "po_number", "po_item", "supplier_id", "sku",
                     "net_amount_usd", "po_net_value_usd", "gr_qty_g", "variance_usd", "status",
                     "match_status", "event_ts"), "event_ts", ["invoice_doc_number"], limit)


def q_summary(inventory: DataFrame, recommendations: DataFrame, prices: DataFrame,
              drafts: DataFrame, inbox: DataFrame, as_of: datetime) -> DataFrame:
    return aggregates.kpi_summary(inventory, recommendations, prices, drafts, inbox, as_of)


MAIL = ["thread_id", "ts", "supplier_id", "supplier_email", "sku", "subject", "intent", "side",
        "email_id"]


def mail(outbox: DataFrame, inbox: DataFrame) -> DataFrame:
    """Both directions of all mail in one shape; sender columns exist only outbound."""
    out = outbox.withColumnRenamed("created_ts", "ts").withColumn("side", F.lit("OUT"))
    came = (
        inbox.withColumnRenamed("received_ts", "ts")
        .withColumnRenamed("intent_detected", "intent")
        .drop("extracted_json", "processed")
        .withColumn("side", F.lit("IN"))
    )
    return out.unionByName(came, allowMissingColumns=True)


def thread_rollup(outbox: DataFrame, inbox: DataFrame) -> DataFrame:
    """Newest message of every thread, either direction.

    One group limit over the union; on equal times outbound mail wins.
    """
    return latest.latest_per_key(
        mail(outbox, inbox).select(*MAIL), ["thread_id"], "ts", ["side", "email_id"]
    ).withColumnRenamed("ts", "last_ts").drop("email_id")


def q_threads(outbox: DataFrame, inbox: DataFrame, limit: int = 25) -> DataFrame:
    _within("limit", limit, 1, 200)
    return latest.newest_first(thread_rollup(outbox, inbox), "last_ts", ["thread_id"], limit)


def thread_messages(outbox: DataFrame, inbox: DataFrame) -> DataFrame:
    """All messages of all threads, oldest first within a thread."""
    return mail(outbox, inbox).orderBy("thread_id", "ts", "email_id")


def q_thread(outbox: DataFrame, inbox: DataFrame, thread_id) -> DataFrame:
    """Messages of one thread, oldest first; the filter reaches both scans."""
    one = F.col("thread_id") == thread_id
    return mail(outbox.where(one), inbox.where(one)).orderBy("ts", "email_id")


def q_po_drafts(drafts: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    _within("limit", limit, 1, 500)
    found = quality.optional_filters(drafts, {"status": status}, ["status"])
    return latest.newest_first(found, "created_ts", ["po_id"], limit)


def q_budget(ledger: DataFrame, period_ym: str, category: str = "SEED",
             entries: int = 20) -> DataFrame:
    """Newest ledger entries of a period, each with the period's current balance."""
    here = ledger.where(F.col("period_ym") == period_ym)
    current = latest.newest_first(
        here.where(F.col("category") == category), "entry_ts", ["ledger_id"], 1)
    balance = current.select(F.max("balance_usd")).scalar()
    stamp = current.select(F.max("entry_ts")).scalar()
    return latest.newest_first(here, "entry_ts", ["ledger_id"], entries).withColumns(
        {"current_balance_usd": balance, "last_entry_ts": stamp})


def q_applications(applications: DataFrame, status: str | None = None) -> DataFrame:
    """One status in full, or the newest fifty of all."""
    found = quality.optional_filters(applications, {"status": status}, ["status"])
    return latest.newest_first(found, "submitted_ts", ["application_id"],
                               None if status else 50)


def q_invoices(invoices: DataFrame, status: str | None = None, limit: int = 100) -> DataFrame:
    found = quality.optional_filters(invoices, {"status": status}, ["status"])
    return latest.newest_first(found, "received_ts", ["reconciliation_id"], limit)


def q_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    _within("limit", limit, 1, 500)
    return latest.newest_first(runs, "started_ts", ["run_id"], limit)


def bottom_k_low_stock(snapshot: DataFrame, k: int = 10) -> DataFrame:
    """The `k` lowest stocks at or under their reorder point."""
    low = quality.below_reorder(snapshot)
    return low.orderBy("on_hand_g", "sku", "room_id").limit(k)
