"""Current-state views over validated feeds."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.constants import CROP_INPUTS, FEATURE_DEFAULTS, FEATURES, SENSOR_BANDS
from harvestline.functions import numbers, scoring, status, text, timing
from harvestline.operators import aggregates, asof, joins, latest, quality, state
from harvestline.session import cut_lineage, cut_slices, slice_of, slices_for

Scorer = Callable[[DataFrame], DataFrame]


def inventory_snapshot(inventory: DataFrame, dim_sku: DataFrame,
                       ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Latest reported stock per SKU and room, with reorder metadata."""
    stock = latest.latest_per_key(inventory, ["sku", "room_id"], ties=ties).select(
        "sku", "room_id", "on_hand_g", F.col("event_ts").alias("last_event_ts"))
    return joins.join_dim_left(stock, dim_sku, "sku", [
        "sku_name", "crop_type", "reorder_point_g", "safety_stock_g", "target_stock_g",
        "organic_preferred"])


def commodity_latest(prices: DataFrame, as_of: datetime,
                     ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Latest price per input with its 1-hour and 24-hour change, from one scan."""
    found = asof.asof_multi(prices, "input_key", "event_ts", "price_usd", as_of, [1, 24],
                            keep=["unit"], ties=ties)
    now = F.col("price_usd")
    return found.select(
        "input_key", "price_usd", "unit", "event_ts",
        *[numbers.pct_change(now, F.col(f"value_{h}h")).alias(f"pct_{h}h") for h in (1, 24)],
    )


def demand_1h(demand: DataFrame) -> DataFrame:
    return aggregates.demand_tumbling(demand)


def supplier_quotes_current(quotes: DataFrame, as_of: datetime,
                            ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Latest quote per SKU and supplier among those still valid: an expired newer quote
    does not hide a valid older one."""
    valid = quality.valid_now(quotes, "valid_until_ts", as_of)
    return latest.latest_per_key(valid, ["sku", "supplier_id"], ties=ties)


def open_po_lines(orders: DataFrame, receipts: DataFrame, suppliers: DataFrame,
                  ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Latest order event per line with receipts, outstanding grams and status."""
    newest = latest.latest_per_key(orders, joins.LINE, ties=ties)
    lines = joins.join_supplier_left(joins.join_composite_left(newest, receipts), suppliers)
    got = F.coalesce(F.col("qty_received_g"), F.lit(0.0))
    return lines.withColumns({
        "qty_received_g": got,
        "qty_outstanding_g": numbers.outstanding(F.col("quantity_g"), F.col("qty_received_g")),
        "po_status": status.po_status(F.col("event_type"), F.col("quantity_g"), got),
    })


def iot_latest(readings: DataFrame, bands: Sequence[tuple] = tuple(SENSOR_BANDS),
               ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Latest reading per room and sensor, with bands and status."""
    newest = latest.latest_per_key(readings, ["room_id", "sensor_type"], ties=ties).select(
        "room_id", "sensor_type", "value", "unit", "event_ts")
    return joins.join_thresholds(newest, bands)


def invoice_matching(invoices: DataFrame, orders: DataFrame, receipts: DataFrame,
                     ties: Sequence[str] = ("event_id",)) -> DataFrame:
    """Latest event per invoice against order value and net receipts.

    Large tables are matched slice by slice: the disk holds the shuffles of one slice, not of all.
    """
    key = ["invoice_doc_number"]
    slices = slices_for(joins.LINE, invoices, orders, receipts)
    if slices == 1:
        return joins.match_lines(latest.latest_per_key(invoices, key, ties=ties), orders, receipts, ties)
    received = cut_lineage(aggregates.receipts_sum(receipts, "gr_qty_g"), "receipts-of-lines")
    newest = cut_slices((latest.latest_per_key(slice_of(invoices, key, i, slices), key, ties=ties)
                         for i in range(slices)), "newest-invoices")
    return cut_slices((joins.match_received(*(slice_of(table, joins.LINE, i, slices)
                                              for table in (newest, orders, received)), ties)
                       for i in range(slices)), "invoice-matching")


def sku_trend(prices_latest: DataFrame, dim_sku: DataFrame,
              crop_inputs: Sequence[tuple] = tuple(CROP_INPUTS)) -> DataFrame:
    """24-hour change of each SKU's grow input."""
    mapped = joins.map_join_left(dim_sku.select("sku", "crop_type"), crop_inputs)
    return joins.trend_fanout(prices_latest, mapped)


def supplier_features(quotes_current: DataFrame, suppliers: DataFrame, demand_hourly: DataFrame,
                      prices_latest: DataFrame, dim_sku: DataFrame,
                      crop_inputs: Sequence[tuple] = tuple(CROP_INPUTS)) -> DataFrame:
    """Current quotes with every model input filled in."""
    joined = joins.feature_join(
        quotes_current,
        suppliers.select("supplier_id", "supplier_name", "on_time_pct", "quality_score",
                         "organic_cert"),
        aggregates.demand_total(demand_hourly),
        sku_trend(prices_latest, dim_sku, crop_inputs),
    )
    flagged = joined.withColumn("organic_cert_int", numbers.flag(F.col("organic_cert")))
    return state.fill_defaults(flagged, FEATURE_DEFAULTS)


BOARD = ["sku", "supplier_id", "supplier_name", "pack_size_g", "unit_price_usd",
         "usd_per_gram", "lead_time_days", "min_qty", "organic", "score", "rank"]


def stored_features(features: DataFrame) -> DataFrame:
    """The columns scoring and ranking need, written out once.

    The scorer's mean, the size check and the rank each read the features again; that must
    not repeat the joins behind them.
    """
    needed = dict.fromkeys([*FEATURES, *BOARD[:-2], "event_ts"])
    return cut_lineage(features.select(*needed), "features")


def supplier_leaderboard(features: DataFrame, scorer: Scorer = scoring.score_closed_form,
                         top: int | None = None) -> DataFrame:
    """Suppliers ranked per SKU by score; give it `stored_features`.

    `top` keeps ranks 1..top through a group limit; without it every row is ranked.
    """
    scored = scorer(features)
    if top is None:
        ranked = latest.score_rank(scored, "sku", "score", "supplier_id")
    else:
        ranked = latest.top_ranked(scored, "sku", "score", "supplier_id", top)
    return ranked.select(*BOARD, F.col("event_ts").alias("quote_ts"))


def recommendations(snapshot: DataFrame, leaderboard: DataFrame, trend: DataFrame,
                    as_of: datetime) -> DataFrame:
    """One reorder action per low SKU and room.

    Low stock without any supplier stays, with NULL supplier and cost.
    """
    best = leaderboard.where("rank = 1").drop("rank")
    low = joins.low_stock_best(quality.below_reorder(snapshot), trend, best)
    sized = low.withColumn(
        "reorder_grams", numbers.shortfall(F.col("target_stock_g"), F.col("on_hand_g"))
    ).withColumn("packs", numbers.packs_up(F.col("reorder_grams"), F.col("pack_size_g")))
    stamp = timing.instant(as_of, snapshot.schema["last_event_ts"].dataType)
    facts = {c: F.col(c) for c in ("on_hand_g", "reorder_point_g", "input_pct_24h", "score")}
    return sized.select(
        text.recommendation_id(F.col("sku"), F.col("room_id"), stamp).alias("recommendation_id"),
        stamp.alias("created_ts"),
        "sku",
        "room_id",
        "reorder_grams",
        "packs",
        F.col("supplier_id").alias("recommended_supplier_id"),
        F.col("supplier_name").alias("recommended_supplier_name"),
        "pack_size_g",
        "unit_price_usd",
        (F.col("packs") * F.col("unit_price_usd")).alias("total_cost_usd"),
        F.col("lead_time_days").alias("expected_lead_days"),
        F.col("score").alias("ml_score"),
        "input_pct_24h",
        status.buy_decision(facts["input_pct_24h"], facts["on_hand_g"],
                            facts["reorder_point_g"], facts["score"]).alias("decision"),
        text.rationale(facts["on_hand_g"], facts["reorder_point_g"], facts["input_pct_24h"],
                       facts["score"]).alias("rationale"),
    )
