"""Arithmetic on money, stock and readings.

Divisions go through `try_divide`: ANSI mode raises on a zero divisor, these yield NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_price(price: Column, pack_grams: Column) -> Column:
    """Price per gram."""
    return F.try_divide(price, pack_grams)


def pct_change(new: Column, old: Column) -> Column:
    """Relative change against `old`; NULL where there is no usable `old`."""
    return F.try_divide(new - old, old)


def shortfall(target: Column, on_hand: Column) -> Column:
    """Grams missing to the target, never negative; an unknown target asks for nothing."""
    return F.greatest(target - on_hand, F.lit(0.0))


def packs_up(grams: Column, pack_grams: Column) -> Column:
    """Packs covering `grams`, rounded up; NULL beyond the range of an int."""
    return F.ceil(F.try_divide(grams, pack_grams)).try_cast("int")


def packs_down(grams: Column, pack_grams: Column, fallback: Column, default: int = 10) -> Column:
    """Whole packs within `grams`; none → `fallback`, none again → `default`; at least one.
    A count beyond the range of an int counts as none."""
    whole = F.try_divide(F.coalesce(grams, F.lit(0.0)), pack_grams).try_cast("int")
    planned = F.coalesce(F.nullif(whole, F.lit(0)), F.nullif(fallback, F.lit(0)), F.lit(default))
    return F.greatest(planned, F.lit(1)).cast("int")


def flag(condition: Column) -> Column:
    """TRUE → 1.0, anything else → 0.0."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def outstanding(ordered: Column, received: Column) -> Column:
    return ordered - F.coalesce(received, F.lit(0.0))


def has_total(expected: Column) -> Column:
    """There is a purchase-order total to compare with; zero counts as none."""
    return F.coalesce(expected != 0, F.lit(False))


def invoice_variance(invoiced: Column, expected: Column) -> Column:
    """Invoiced minus expected; everything where nothing was expected."""
    billed = F.coalesce(invoiced, F.lit(0.0))
    return billed - F.when(has_total(expected), expected).otherwise(F.lit(0.0))


def invoice_variance_pct(invoiced: Column, expected: Column) -> Column:
    """Variance in percent of the expected total; 100 where nothing was expected."""
    gap = F.abs(invoice_variance(invoiced, expected))
    return F.when(has_total(expected), F.try_divide(gap, expected) * 100.0).otherwise(F.lit(100.0))


def gauge_fraction(value: Column, low: Column, high: Column) -> Column:
    """Position of `value` between the display bounds, clamped to 0..1.

    Missing bounds are 0 and 100; an empty range has width one.
    """
    lo = F.coalesce(low, F.lit(0.0))
    hi = F.coalesce(high, F.lit(100.0))
    width = F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0))
    share = (F.coalesce(value, F.lit(0.0)) - lo) / width
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def round_money(value: Column, digits: int = 2) -> Column:
    return F.round(value, digits)
