"""Status columns. Each rule set is written as ordered (status, condition) pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(pairs: list[tuple[str, Column]], otherwise: str) -> Column:
    """Name of the first condition that is TRUE."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in pairs], F.lit(otherwise))


def po_status(event_type: Column, ordered: Column, received: Column) -> Column:
    """Cancellation wins; 99 % received counts as complete."""
    return first_match(
        [
            ("CANCELLED", event_type == "CANCELLED"),
            ("FULLY_RECEIVED", received >= 0.99 * ordered),
            ("PARTIALLY_RECEIVED", received > 0),
        ],
        "OPEN",
    )


def match_status(po_value: Column, received: Column, variance: Column) -> Column:
    """Three-way match; net receipts of exactly zero are still pending."""
    return first_match(
        [
            ("NO_PO", po_value.isNull()),
            ("PENDING_GR", received == 0),
            ("MATCHED", F.abs(variance) <= 0.02 * po_value),
        ],
        "VARIANCE",
    )


def sensor_status(value: Column, alert_min: Column, alert_max: Column,
                  warn_min: Column, warn_max: Column) -> Column:
    """Outside the alert band, outside the warn band, else nominal (no bands: nominal)."""
    return first_match(
        [
            ("ALERT", ~value.between(alert_min, alert_max)),
            ("CAUTION", ~value.between(warn_min, warn_max)),
        ],
        "NOMINAL",
    )


def reconcile_status(pct: Column, known_total: Column) -> Column:
    """1 % and 5 % bounds are inclusive; no total to compare with is a dispute."""
    return first_match(
        [
            ("DISPUTE", ~known_total),
            ("OK", pct <= 1.0),
            ("REVIEW", pct <= 5.0),
        ],
        "DISPUTE",
    )


def buy_decision(trend: Column, on_hand: Column, reorder_point: Column, score: Column) -> Column:
    """Buy on a rising input, on deep shortage or on a strong offer; wait on a falling
    input while stock is near the reorder point; anything else goes to review."""
    rising, falling = trend > 0.01, trend < -0.01
    deep_shortage = on_hand < 0.5 * reorder_point
    near_reorder = on_hand > 0.8 * reorder_point
    return first_match(
        [
            ("BUY_NOW", rising | deep_shortage | (score > 0.85)),
            ("WAIT", falling & near_reorder),
        ],
        "REVIEW",
    )


def onboard_verdict(score: Column) -> Column:
    return first_match([("APPROVED", score >= 0.75), ("SCREENING", score >= 0.5)], "REJECTED")
