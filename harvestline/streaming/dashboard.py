"""The dashboard row kept by signed changes while five feeds move.

Each keyed feed has a state of its newest rows. A batch reads the rows of the keys it touches as they
were before, works out what the batch makes of them and adds the difference of their contributions
to one table of facts: `(fact, at, n, micros)`. So a batch costs what it touches, and a read adds up
a table that holds one row per fact and, for the facts about recommendations, one per creation time.

Windows need no timers: their facts carry the creation time, and a read takes those behind its own
`as_of`. Each batch states the `as_of` below which nobody will read; compaction drops what even that
reader would not see. A correction that comes after that lands outside every window as well.

Copies change nothing (the state already holds the row), a replayed batch overwrites its deltas, and
late rows count only if they are the newest of their key. Money is added in whole micro-dollars, so
the sum does not depend on the order. A NULL amount adds nothing, as in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harvestline.functions import timing
from harvestline.session import cut_lineage
from harvestline.streaming.feeds import for_each_batch
from harvestline.streaming.joined import tagged
from harvestline.streaming.versions import COMPACT_EVERY, Fold, VersionedTable, added_up, newest_by

WINDOW = timedelta(hours=1)    # the longest window of a fact
_KINDS = {"fact": "string", "at": "timestamp", "n": "bigint", "micros": "decimal(38,0)"}
# feed: its key, the time that orders versions of a key, and what breaks ties of that time
KEYED = {
    "inventory": (["sku", "room_id"], "event_ts", ["event_id"]),
    "recommendations": (["recommendation_id"], "created_ts", ["decision", "total_cost_usd"]),
    "drafts": (["po_id"], "changed_ts", ["status"]),
    "inbox": (["email_id"], "changed_ts", ["processed"]),
}
FEEDS = (*KEYED, "prices")


def _fact(name: str, holds: Column, n: Column | None = None, micros: Column | None = None,
          at: Column | None = None) -> Column:
    """One fact a row contributes to, NULL if it does not."""
    values = {"fact": F.lit(name), "at": at, "n": F.lit(1) if n is None else n, "micros": micros}
    return F.when(holds, F.struct(*[
        (F.lit(None) if values[c] is None else values[c]).cast(kind).alias(c) for c, kind in _KINDS.items()]))


def _contributions() -> dict[str, list[Column]]:
    micros = F.round(F.coalesce("total_cost_usd", F.lit(0.0)).cast("decimal(30,8)") * 1_000_000)
    return {
        "inventory": [_fact("low", F.col("on_hand_g") <= F.col("reorder_point_g"))],
        "recommendations": [
            _fact("buy_now", F.col("decision") == "BUY_NOW", at=F.col("created_ts")),
            _fact("spend", F.lit(True), micros=micros, at=F.col("created_ts"))],
        "drafts": [_fact("open", F.col("status") == "DRAFT")],
        "inbox": [_fact("unprocessed", ~F.coalesce("processed", F.lit(False)))],
    }


def _facts() -> Fold:
    """Fold of the facts: changes added up, without what no reader may ask for any more."""
    add = added_up(["fact", "at"], "n", "micros")

    def fold(rows: DataFrame) -> DataFrame:
        horizon = rows.agg(F.max(F.when(F.col("fact") == "as_of", F.col("at")))).scalar()
        seen = F.col("fact").isin("buy_now", "spend") & (F.col("at") <= horizon - F.lit(WINDOW))
        newest = rows.where("fact IN ('tick', 'as_of')").groupBy("fact").agg(
            F.max("at").alias("at"), F.max("n").alias("n"), F.max("micros").alias("micros"),
            F.max("batch_id").alias("batch_id"))
        summed = add(rows.where("fact NOT IN ('tick', 'as_of')").where(~F.coalesce(seen, F.lit(False))))
        return summed.unionByName(newest)

    return fold


class Dashboard:
    """States of the keyed feeds and the facts, stored below `path`."""

    def __init__(self, spark: SparkSession, path: str, dim_sku: DataFrame, every: int = COMPACT_EVERY):
        self.dim_sku = dim_sku.select("sku", "reorder_point_g")
        self.states = {feed: VersionedTable(spark, f"{path}/{feed}", newest_by(keys, ts, ties), every)
                       for feed, (keys, ts, ties) in KEYED.items()}
        self.facts = VersionedTable(spark, f"{path}/facts", _facts(), every)

    def _signed(self, feed: str, rows: DataFrame | None, sign: int) -> list[DataFrame]:
        if rows is None:
            return []
        if feed == "inventory":
            rows = rows.join(self.dim_sku, "sku", "left")
        given = rows.select(F.inline(F.filter(F.array(*_contributions()[feed]), lambda f: f.isNotNull())))
        return [given.select("fact", "at", (sign * F.col("n")).alias("n"), (sign * F.col("micros")).cast(
            _KINDS["micros"]).alias("micros"))]

    def add(self, batches: Mapping[str, DataFrame], batch_id: int, as_of: datetime) -> None:
        """Take in one batch of each feed named; readers will ask for `as_of` or later."""
        spark = self.dim_sku.sparkSession
        changes = [spark.range(1).select(F.lit("as_of").alias("fact"), timing.instant(as_of).cast("timestamp").alias("at"),
                                         F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(_KINDS["micros"]).alias("micros"))]
        for feed, state in self.states.items():
            if feed not in batches:
                continue
            keys = KEYED[feed][0]
            new = cut_lineage(state.fold(batches[feed].withColumn("batch_id", F.lit(batch_id).cast("long")))
                              .drop("batch_id"), f"{feed}-new")
            touched = new.select(*keys)
            before = state.read(touched, keys, before=batch_id)
            state.write(new, batch_id)
            changes += self._signed(feed, before, -1) + self._signed(feed, state.read(touched, keys), 1)
        if "prices" in batches:
            tick = batches["prices"].agg(F.max("event_ts").cast("timestamp").alias("at"))
            changes.append(tick.select(F.lit("tick").alias("fact"), "at", F.lit(0).cast("bigint").alias("n"),
                                       F.lit(None).cast(_KINDS["micros"]).alias("micros")))
        summed = reduce(DataFrame.unionByName, changes).groupBy("fact", "at").agg(
            F.sum("n").alias("n"), F.sum("micros").cast(_KINDS["micros"]).alias("micros"))
        self.facts.write(summed.where("n <> 0 OR micros <> 0 OR fact IN ('tick', 'as_of')"), batch_id)

    def read(self, as_of: datetime) -> DataFrame | None:
        """The row `aggregates.kpi_summary` gives, None before the first batch; an `as_of` before the
        one of the last batch is refused, since its windows may be gone."""
        facts = self.facts.read()
        if facts is None:
            return None
        stated = timing.instant_like(facts, "at", as_of)
        if not facts.where("fact = 'as_of'").where(F.col("at") > stated).isEmpty():
            raise ValueError("the facts were kept for a later as_of")

        def total(fact: str, value: str, since: timedelta | None = None) -> Column:
            holds = F.col("fact") == fact
            if since is not None:
                holds &= timing.since(facts, "at", as_of, strict=True, seconds=since.total_seconds())
            return F.coalesce(F.sum(F.when(holds, F.col(value))), F.lit(0))

        return facts.agg(
            total("low", "n").alias("skus_below_reorder"),
            total("buy_now", "n", timedelta(minutes=5)).alias("buy_now_last_5m"),
            (total("spend", "micros", WINDOW).cast("double") / 1_000_000).alias("spend_pending_1h_usd"),
            F.max(F.when(F.col("fact") == "tick", F.col("at"))).alias("last_market_tick"),
            total("open", "n").alias("po_drafts_open"),
            total("unprocessed", "n").alias("inbound_unprocessed"))

    def follow(self, checkpoint: str, as_of: Callable[[], datetime], *, every: str | None = None,
               **feeds: DataFrame) -> StreamingQuery:
        """Keep the row current over streams of any of `FEEDS`; `as_of()` is asked once a batch."""
        if unknown := set(feeds) - set(FEEDS):
            raise ValueError(f"no such feeds: {sorted(unknown)}")

        def apply(batch: DataFrame, batch_id: int) -> None:
            batch = cut_lineage(batch, "dashboard-batch")
            self.add({f: batch.where(F.col(f).isNotNull()).select(f"{f}.*") for f in feeds}, batch_id, as_of())

        return for_each_batch(tagged(**feeds), apply, checkpoint, every=every)
