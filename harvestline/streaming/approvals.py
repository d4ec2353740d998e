"""Approvals as keyed state of the stream engine: one balance per period.

Drafts wait in the state of their period until the watermark has passed them and are then decided
in (created_ts, po_id) order, so decisions equal those of the batch operator however the drafts are
split into batches, as long as none is later than `lateness`. A timer at the earliest waiting draft
decides without new input; a timer at the end of the period frees its state. What arrives for a
closed period is rejected.

Decisions of one period follow each other by nature, so a period is one key. Its state is a
balance and the drafts of the last `lateness`; RocksDB keeps it, checkpoints it incrementally and
recovers it on another executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from harvestline.constants import MONTHLY_BUDGET_USD, SEED_CATEGORY
from harvestline.functions import text, timing
from harvestline.operators import budget
from harvestline.sources.readers import with_instants

DRAFT = ["po_id", "at", "cost"]


def period_end_ms(period: str) -> int:
    """First instant after a month `YYYY-MM`, in milliseconds; 0 for any other text."""
    try:
        first = datetime.strptime(period, "%Y-%m")
    except (TypeError, ValueError):
        return 0
    after = datetime(first.year + first.month // 12, first.month % 12 + 1, 1, tzinfo=timezone.utc)
    return int(after.timestamp() * 1000)


class Approver(StatefulProcessor):
    """Decides the drafts of one period in time order against its balance."""

    def __init__(self, micros: int, id_type: str):
        self.micros, self.id_type = micros, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "left long")
        self.waiting = handle.getListState("waiting", f"po_id {self.id_type}, at long, cost long")

    def _advance(self, period: str, drafts: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Decide what the watermark has passed; the rest waits, with a timer at the first of it."""
        end = period_end_ms(period)
        closed = bool(end) and watermark_ms >= end
        ready = sorted((d for d in drafts if d[1] < watermark_ms * 1000), key=lambda d: (d[1], d[0]))
        later = [d for d in drafts if d[1] >= watermark_ms * 1000]
        known = self.left.exists()
        left = self.left.get()[0] if known else 0 if closed and not self.waiting.exists() else self.micros
        shut = closed and not known and not self.waiting.exists()
        out = []
        for po_id, at, cost in ready:
            fits = not shut and cost <= left
            left -= cost if fits else 0
            out.append((po_id, period, at, fits, left / budget.MICROS if fits else None))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(d[1] for d in later) // 1000 + 1)
        else:
            self.waiting.clear()
        if closed and not later:
            self.left.clear()
        else:
            self.left.update((left,))
            if end:
                self.handle.registerTimer(end)
        if out:
            yield pd.DataFrame(out, columns=["po_id", "period_ym", "at", "approved", "balance_after"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        drafts = [d for frame in rows for d in zip(*(frame[c].tolist() for c in DRAFT))]
        held = list(self.waiting.get()) if self.waiting.exists() else []
        yield from self._advance(key[0], held + drafts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        if held or self.left.exists():
            yield from self._advance(key[0], held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_approvals(drafts: DataFrame, *, lateness: str = "1 day", amount: float = MONTHLY_BUDGET_USD,
                     category: str = SEED_CATEGORY) -> DataFrame:
    """Decisions (po_id, period_ym, created_ts, approved, balance_after, category, ledger_id) as a stream.

    `drafts` has po_id, created_ts and total_cost_usd, and may have period_ym. A draft is decided
    once the watermark (newest created_ts less `lateness`) has passed it.
    """
    shaped = with_instants(drafts).withWatermark("created_ts", lateness)
    if "period_ym" not in shaped.columns:
        shaped = shaped.withColumn("period_ym", timing.period_ym(F.col("created_ts")))
    kind = shaped.schema["po_id"].dataType.simpleString()
    rows = shaped.select("po_id", "created_ts", "period_ym", F.unix_micros("created_ts").alias("at"),
                         budget.to_micros(F.col("total_cost_usd")).alias("cost"))
    decided = rows.groupBy("period_ym").transformWithStateInPandas(
        Approver(round(amount * budget.MICROS), kind),
        f"po_id {kind}, period_ym string, at long, approved boolean, balance_after double", "append", "eventTime")
    return decided.select("po_id", "period_ym", F.timestamp_micros("at").alias("created_ts"), "approved", "balance_after",
                          F.lit(category).alias("category"), text.stable_id("LED", F.col("po_id")).alias("ledger_id"))
