"""Validated feeds: row rules, duplicate removal, derived columns. Batch or stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.functions import numbers, timing
from harvestline.operators.quality import Rule, dedup_event_id, expect_or_drop


def _present(*columns: str) -> list[Rule]:
    return [Rule(f"has_{c}", f"{c} IS NOT NULL") for c in columns]


def _positive(*columns: str) -> list[Rule]:
    return [Rule(f"positive_{c}", f"{c} > 0") for c in columns]


def _not_negative(*columns: str) -> list[Rule]:
    return [Rule(f"non_negative_{c}", f"{c} >= 0") for c in columns]


def _per_gram(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "usd_per_gram", numbers.unit_price(F.col("unit_price_usd"), F.col("pack_size_g")))


class Feed(NamedTuple):
    rules: list[Rule]
    derive: Callable[[DataFrame], DataFrame] | None = None


FEEDS: dict[str, Feed] = {
    "inventory_events": Feed([*_present("event_ts", "sku", "room_id"),
                              *_not_negative("on_hand_g")]),
    "supplier_quotes": Feed([*_positive("unit_price_usd", "pack_size_g"),
                             *_not_negative("lead_time_days")], _per_gram),
    "demand_events": Feed(_positive("trays", "grams_req")),
    "commodity_prices": Feed([*_positive("price_usd"), *_present("input_key")]),
    "purchase_orders": Feed([*_positive("quantity_g", "unit_price_usd"),
                             *_present("supplier_id")]),
    "goods_receipts": Feed(_present("po_number", "sku")),
    "invoice_documents": Feed(_present("po_number", "supplier_id")),
    "iot_sensor_events": Feed(_present("room_id", "sensor_type", "value")),
}


def validated(feed: str, events: DataFrame) -> DataFrame:
    """Rules and derived columns only. Rules run first: they prune before any shuffle and
    keep divisions away from rows they would fail on."""
    spec = FEEDS[feed]
    kept = expect_or_drop(events, spec.rules)
    return spec.derive(kept) if spec.derive else kept


def deduplicated(feed: str, events: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The validated feed, one row per event id: what views that add up read.

    `columns` narrows what is shuffled to find copies. Views of newest rows need no removal:
    they break ties by event id, so a copy can't change them and `validated` will do.
    """
    kept = validated(feed, events)
    return dedup_event_id(kept.select("event_id", *columns) if columns else kept)


def silver(feed: str, events: DataFrame) -> DataFrame:
    """The deduplicated feed, stamped with its processing time."""
    return timing.ingest_ts(deduplicated(feed, events))
