"""Row rules, duplicate removal and table audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.functions import timing


class Rule(NamedTuple):
    """A named row rule; `predicate` is a SQL condition."""

    name: str
    predicate: str

    def holds(self) -> Column:
        """TRUE only where the predicate is TRUE: NULL breaks a rule."""
        return F.coalesce(F.expr(self.predicate), F.lit(False))


def expect_or_drop(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Keep the rows that satisfy every rule. One filter, pushed to the scan."""
    return df.where(reduce(and_, [F.expr(r.predicate) for r in rules]))


def rule_metrics(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows kept and dropped per rule, in one pass over the table."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(r.holds()).alias(f"ok_{i}") for i, r in enumerate(rules)],
    )
    per_rule = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.col(f"ok_{i}").alias("passed"),
                 (F.col("total") - F.col(f"ok_{i}")).alias("dropped"))
        for i, r in enumerate(rules)
    ])
    return counts.select(F.inline(per_rule))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows `expect_or_drop` would drop, with the names of the rules they break."""
    broken = F.filter(
        F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]), lambda n: n.isNotNull()
    )
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def dedup_event_id(df: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per event id. Copies collapse on the map side first.

    Where copies differ, a batch keeps the least row by its other columns in table order (NULLs
    first); a stream keeps the copy that arrives first.
    """
    if df.isStreaming:
        return df.dropDuplicates([key])
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    least = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return least.select(*[c if c == key else F.col("_row")[c].alias(c) for c in df.columns])


def pk_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count, distinct key count and whether they agree.

    Counted from per-key totals: the copies of a hot key collapse before the shuffle.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
    ).withColumn("is_unique", F.col("total_rows") == F.col("distinct_keys"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise if a key repeats. Only one offending key travels to the driver."""
    offender = duplicate_keys(df, keys).head(1)
    if offender:
        raise ValueError(f"{what}: key {list(keys)} repeats, e.g. {offender[0].asDict()}")


def violation_counts(df: DataFrame, checks: Mapping[str, str]) -> DataFrame:
    """Rows that meet each SQL condition (a condition describes a fault)."""
    row = df.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations"))
                      for n in checks])
    return row.select(F.inline(pairs))


def domain_audit(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Distinct values outside the allowed set; NULL is not judged."""
    return (
        df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))
        .groupBy(F.col(column).alias("unexpected"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def freshness_audit(df: DataFrame, ts: str, as_of: datetime, within: timedelta) -> DataFrame:
    """Newest timestamp and how many rows are newer than `as_of - within`."""
    recent = F.col(ts) > timing.instant_like(df, ts, timing.resolve(as_of) - within)
    return df.agg(F.max(ts).alias("latest"), F.count_if(recent).alias("recent_rows"))


def schema_audit(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per required column: present or not, and its number of non-NULL values."""
    have = set(df.columns)
    counts = df.agg(*[
        (F.count(c) if c in have else F.lit(0).cast("bigint")).alias(f"n_{i}")
        for i, c in enumerate(required)
    ], F.count(F.lit(1)).alias("_rows"))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(c in have).alias("present"),
                 F.col(f"n_{i}").alias("non_null"))
        for i, c in enumerate(required)
    ])))


def optional_filters(df: DataFrame, equals: Mapping[str, object],
                     enums: Sequence[str] = ()) -> DataFrame:
    """Equality on the parameters that were given; enum parameters are upper-cased."""
    given = [
        F.col(c) == (str(v).upper() if c in enums else v)
        for c, v in equals.items() if v is not None and v != ""
    ]
    return df.where(reduce(and_, given)) if given else df


def valid_now(df: DataFrame, until: str, as_of: datetime) -> DataFrame:
    """Rows still valid at `as_of` (strictly)."""
    return df.where(F.col(until) > timing.instant_like(df, until, as_of))


def below_reorder(df: DataFrame, on_hand: str = "on_hand_g",
                  threshold: str = "reorder_point_g") -> DataFrame:
    """Stock at or under its reorder point; an unknown point keeps nothing."""
    return df.where(F.col(on_hand) <= F.col(threshold))


def unprocessed(df: DataFrame, done: str = "processed") -> DataFrame:
    """Rows not marked done; NULL counts as not done."""
    return df.where(~F.coalesce(F.col(done), F.lit(False)))


def status_in(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(*values))


def lookback(df: DataFrame, ts: str, as_of: datetime, *, strict: bool = False,
             **span: float) -> DataFrame:
    """Rows of the last hours= / minutes= / days= before `as_of`."""
    return df.where(timing.since(df, ts, as_of, strict=strict, **span))
