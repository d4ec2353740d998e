"""Gold views kept current from streams.

A micro-batch is written below its own id, so a batch that is replayed after a failure
overwrites itself. A view reads the newest version of each key. Rows per batch are the
keys the batch touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harvestline.constants import MONTHLY_BUDGET_USD, SEED_CATEGORY
from harvestline.functions import text, timing
from harvestline.operators import aggregates, budget, latest
from harvestline.session import cut_lineage
from harvestline.sources import sinks
from harvestline.sources.readers import with_instants
from harvestline.streaming.feeds import for_each_batch
from harvestline.streaming.versions import VersionedTable, last_version


def newest_versions(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of each key of a table written batch by batch."""
    return VersionedTable(spark, path, last_version(keys)).read()


def _upsert_batches(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Each batch is a delta; older deltas are folded into a base as they gather."""
    def write(batch: DataFrame, batch_id: int) -> None:
        VersionedTable(batch.sparkSession, path, last_version(keys)).write(batch, batch_id)

    return write


def stream_tumbling(demand: DataFrame, path: str, checkpoint: str, *, lateness: str = "2 hours",
                    every: str | None = None) -> StreamingQuery:
    """Hourly demand, updated as events arrive. Hours older than the watermark are closed:
    rows that come later still are dropped, and their state is freed."""
    hourly = aggregates.demand_tumbling(
        with_instants(demand).withWatermark("event_ts", lateness))
    return for_each_batch(hourly, _upsert_batches(path, ["sku", "hour_ts"]), checkpoint, mode="update", every=every)


def stream_latest(events: DataFrame, keys: Sequence[str], path: str, checkpoint: str, *,
                  ts: str = "event_ts", ties: Sequence[str] = ("event_id",),
                  every: str | None = None) -> StreamingQuery:
    """Newest row per key, updated as events arrive; one state row per key.

    Late rows are never lost: an older row simply does not win.
    """
    rest = [c for c in events.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(ts, *ties)).alias("_row")
    running = events.groupBy(*keys).agg(newest).select(*keys, "_row.*")
    return for_each_batch(running, _upsert_batches(path, keys), checkpoint, mode="update", every=every)


def stream_latest_view(events: DataFrame, keys: Sequence[str], state_path: str,
                       publish: Callable[[DataFrame, int], None], checkpoint: str, *,
                       ts: str = "event_ts", ties: Sequence[str] = ("event_id",),
                       every: str | None = None) -> StreamingQuery:
    """Refresh a joined view whenever its feed advances.

    The newest row per key is kept as a table: each batch merges it with the batch's rows
    and hands the result to `publish(current, batch_id)`, which joins dimensions and
    syncs the serving copy. Work per batch follows the batch and the number of keys, not
    the history. Late rows count as long as they are newer than what the key has.
    """
    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = [batch]
        previous = _path_before(spark, state_path, batch_id)
        if previous is not None:
            known.append(spark.read.schema(batch.schema).parquet(previous))
        merged = known[0] if len(known) == 1 else known[0].unionByName(known[1])
        sinks.write_batch(latest.latest_per_key(merged, keys, ts, ties), state_path, batch_id)
        current = spark.read.schema(batch.schema).parquet(f"{state_path}/batch_id={batch_id}")
        publish(current, batch_id)

    return for_each_batch(events, refresh, checkpoint, every=every)


def _path_before(spark: SparkSession, path: str, batch_id: int) -> str | None:
    """Folder of the last complete batch before `batch_id`, from the folder names alone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(conf)
    if not files.exists(folder):
        return None
    ids = [
        int(name.split("=")[1])
        for name in (s.getPath().getName() for s in files.listStatus(folder))
        if name.startswith("batch_id=")
    ]
    earlier = [i for i in ids if i < batch_id]
    return f"{path}/batch_id={max(earlier)}" if earlier else None


def stream_budget(drafts: DataFrame, decisions_path: str, ledger_path: str, checkpoint: str, *,
                  amount: float = MONTHLY_BUDGET_USD, category: str = SEED_CATEGORY,
                  every: str | None = None) -> StreamingQuery:
    """Approve drafts as they arrive against running balances per `period_ym`.

    Each micro-batch is decided by the batch operator, so a large period is split the
    same way; the carried state is one balance per period. Within a batch drafts are
    taken in time order, across batches in order of arrival.
    """
    def decide(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        previous = _path_before(spark, ledger_path, batch_id)
        periods = batch.select("period_ym").distinct()
        start = F.lit(float(amount))
        if previous is None:
            balances = periods.withColumn("balance_usd", start)
        else:
            known = spark.read.parquet(previous)
            balances = known.join(periods, "period_ym", "full").select(
                "period_ym", F.coalesce("balance_usd", start).alias("balance_usd"))
        decided = cut_lineage(
            budget.greedy_allocate(batch, balances, ["period_ym"], ["created_ts", "po_id"],
                                   "total_cost_usd"), "stream-budget")
        sinks.write_batch(
            decided.select(
                "po_id", "period_ym", "created_ts", "total_cost_usd", "approved",
                "balance_after", F.lit(category).alias("category"),
                text.stable_id("LED", F.col("po_id")).alias("ledger_id")),
            decisions_path, batch_id)
        spent = decided.where("approved").groupBy("period_ym").agg(
            F.sum(budget.to_micros(F.col("total_cost_usd"))).alias("_spent"))
        left = budget.to_micros(F.col("balance_usd")) - F.coalesce("_spent", F.lit(0))
        sinks.write_batch(
            balances.join(spent, "period_ym", "left").select(
                "period_ym", (left / F.lit(float(budget.MICROS))).alias("balance_usd")),
            ledger_path, batch_id)

    shaped = with_instants(drafts)
    if "period_ym" not in shaped.columns:
        shaped = shaped.withColumn("period_ym", timing.period_ym(F.col("created_ts")))
    return for_each_batch(shaped, decide, checkpoint, every=every)


