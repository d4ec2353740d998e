"""Streams over the event table, run to completion, checked against batch SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from harvestline.checks import gold as gold_views
from harvestline.checks.registry import CHECKS, ROUNDED, Tables, query
from harvestline.functions import timing
from harvestline.operators import aggregates
from harvestline.plans import gold, silver
from harvestline.session import cut_lineage, scratch_path
from harvestline.sources import bindings, readers, sinks
from harvestline.sources.bindings import PERIOD_BUDGET_USD
from harvestline.streaming import approvals, asof, dashboard, feeds, ids, joined, recent, views


def _stream(t: Tables, feed: str):
    """A feed as a stream over the whole source table."""
    source = bindings.BINDINGS[feed].source
    path = readers.table_path(t.folder, source)
    schema = t.spark.read.parquet(path).schema
    return bindings.project(readers.stream_source(t.spark, readers.one_file(path), schema), feed)


def _appended(t: Tables, df, label: str):
    out = scratch_path(t.spark, label)
    feeds.append_to(df, out, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.schema(df.schema).parquet(out)


@query("stream_source", "SELECT event_id, event_ts, input_key, price_usd FROM commodity_prices")
def stream_source(t: Tables):
    prices = _stream(t, "commodity_prices").select(
        "event_id", "event_ts", "input_key", "price_usd")
    return _appended(t, prices, "stream-source")


@query("stream_silver", """
    SELECT event_id, event_ts, sku, room_id, on_hand_g FROM inventory_events
    WHERE on_hand_g >= 0""")
def stream_silver(t: Tables):
    stock = feeds.stream_silver("inventory_events", _stream(t, "inventory_events"))
    return _appended(t, stock.drop("reason"), "stream-silver")


@query("stream_dedup", "SELECT event_id, price_usd FROM commodity_prices")
def stream_dedup(t: Tables):
    prices = _stream(t, "commodity_prices").select("event_id", "price_usd")
    return _appended(t, feeds.stream_dedup(prices.union(prices)), "stream-dedup")


@query("stream_dedup_bounded", "SELECT event_id, price_usd FROM commodity_prices")
def stream_dedup_bounded(t: Tables):
    prices = _stream(t, "commodity_prices").select("event_id", "event_ts", "price_usd")
    once = feeds.stream_dedup_bounded(prices.union(prices), lateness="31 days")
    return _appended(t, once.drop("event_ts"), "stream-dedup-bounded")


@query("stream_dedup_stored", "SELECT event_id, input_key, event_ts, price_usd FROM commodity_prices")
def stream_dedup_stored(t: Tables):
    """The feed in two deliveries and then whole again; ids seen lie in files behind Bloom filters."""
    prices = t.commodity_prices.select("event_id", "input_key", "event_ts", "price_usd")
    folder, out = scratch_path(t.spark, "prices-again"), scratch_path(t.spark, "prices-once")
    half = timing.instant_like(prices, "event_ts", datetime(2024, 1, 16))
    source = readers.stream_source(t.spark, folder, prices.schema)
    seen = ids.SeenIds(t.spark, f"{out}-ids", per_part=1_000_000, every=2)
    for part in (prices.where(F.col("event_ts") >= half), prices.where(F.col("event_ts") < half), prices):
        sinks.append_sink(part, folder)
        seen.follow(source, out, f"{out}-checkpoint").awaitTermination()
    return sinks.read_batches(t.spark, out).drop("batch_id")


@query("stream_tumbling", """
    SELECT sku, hour_ts, trays, R(grams_req) AS grams_req FROM gd_demand_1h""", round_to=3)
def stream_tumbling(t: Tables):
    out = scratch_path(t.spark, "stream-demand")
    twice = _stream(t, "demand_events")
    demand = feeds.stream_silver("demand_events", twice.union(twice))
    views.stream_tumbling(demand, out, f"{out}-checkpoint",
                          lateness="31 days").awaitTermination()
    return views.newest_versions(t.spark, out, ["sku", "hour_ts"])


@query("stream_latest", """
    SELECT room_id, sensor_type, value, event_ts FROM gd_iot_latest""")
def stream_latest(t: Tables):
    out = scratch_path(t.spark, "stream-iot")
    readings = _stream(t, "iot_sensor_events").drop("unit")
    views.stream_latest(readings, ["room_id", "sensor_type"], out,
                        f"{out}-checkpoint").awaitTermination()
    return views.newest_versions(t.spark, out, ["room_id", "sensor_type"]).drop("event_id")


@query("stream_gold_refresh", """
    SELECT sku, room_id, on_hand_g, last_event_ts, crop_type, reorder_point_g
    FROM gd_inventory_snapshot""")
def stream_gold_refresh(t: Tables):
    out = scratch_path(t.spark, "stream-gold")
    dim = t.dim_sku

    def publish(current, batch_id):
        sinks.snapshot_sync(gold.inventory_snapshot(current, dim), f"{out}-serving",
                            ["sku", "room_id"])

    stock = feeds.stream_silver("inventory_events", _stream(t, "inventory_events"))
    views.stream_latest_view(stock, ["sku", "room_id"], out, publish,
                             f"{out}-checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{out}-serving").select(
        "sku", "room_id", "on_hand_g", "last_event_ts", "crop_type", "reorder_point_g")


@query("late_data", """
    SELECT sku, room_id, on_hand_g, event_ts FROM inventory_events
    QUALIFY row_number() OVER (PARTITION BY sku, room_id ORDER BY event_ts DESC, event_id DESC)
            = 1""")
def late_data(t: Tables):
    """The newest half of the feed arrives first; late rows still find their place."""
    events = t.inventory_events
    folder = scratch_path(t.spark, "late-feed")
    late = F.col("event_ts") < timing.instant(bindings.AS_OF_EVENTS.replace(day=15))
    sinks.append_sink(events.where(~late).coalesce(1), folder)
    sinks.append_sink(events.where(late).coalesce(1), folder)
    feed = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option(
        "latestFirst", "false").parquet(folder)
    out = scratch_path(t.spark, "late-state")
    views.stream_latest(feed, ["sku", "room_id"], out, f"{out}-checkpoint").awaitTermination()
    return views.newest_versions(t.spark, out, ["sku", "room_id"]).select(
        "sku", "room_id", "on_hand_g", "event_ts")


@query("stream_budget", """
    SELECT po_id, period AS period_ym, approved,
           CASE WHEN approved THEN R(left_after) END AS balance_after FROM budget_walk""",
       round_to=2)
def stream_budget(t: Tables):
    out = scratch_path(t.spark, "stream-budget")
    drafts = _stream(t, "po_drafts").select("po_id", "created_ts", "total_cost_usd")
    views.stream_budget(drafts, f"{out}-decisions", f"{out}-ledger", f"{out}-checkpoint",
                        amount=PERIOD_BUDGET_USD).awaitTermination()
    return sinks.read_batches(t.spark, f"{out}-decisions").select(
        "po_id", "period_ym", "approved", "balance_after")


@query("at_least_once_replay", """
    SELECT sku, count(*) AS events, R(sum(grams_req)) AS grams_req FROM sv_demand_events
    GROUP BY sku""", round_to=3)
def at_least_once_replay(t: Tables):
    """The same table delivered twice counts once."""
    feed = scratch_path(t.spark, "replay-feed")
    for _ in range(2):
        sinks.append_sink(t.demand_events, feed)
    stream = readers.stream_source(t.spark, feed, t.demand_events.schema, max_files=4)
    once = _appended(t, feeds.stream_silver("demand_events", stream), "replay")
    return once.groupBy("sku").agg(F.count(F.lit(1)).alias("events"),
                                     F.sum("grams_req").alias("grams_req"))


@query("stream_approvals", """
    SELECT po_id, period AS period_ym, approved,
           CASE WHEN approved THEN R(left_after) END AS balance_after FROM budget_walk""",
       round_to=2)
def stream_approvals(t: Tables):
    """Drafts in two deliveries, the later half first; a beat without cost moves the watermark on."""
    feed = scratch_path(t.spark, "drafts-feed")
    drafts = t.po_drafts.select("po_id", "created_ts", "total_cost_usd")
    half = timing.instant_like(drafts, "created_ts", datetime(1995, 1, 1))
    sinks.append_sink(drafts.where(F.col("created_ts") >= half).coalesce(1), feed)
    sinks.append_sink(drafts.where(F.col("created_ts") < half).coalesce(1), feed)
    beat = t.spark.range(1).select(
        F.lit(-1).cast(drafts.schema["po_id"].dataType).alias("po_id"),
        F.lit(datetime(2100, 1, 1)).cast(drafts.schema["created_ts"].dataType).alias("created_ts"),
        F.lit(None).cast("double").alias("total_cost_usd"))
    out = scratch_path(t.spark, "approvals")
    for late in (False, True):
        if late:
            sinks.append_sink(beat, feed)
        source = readers.stream_source(t.spark, feed, drafts.schema, max_files=1)
        decided = approvals.stream_approvals(source, lateness="10000 days", amount=PERIOD_BUDGET_USD)
        feeds.append_to(decided, out, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.schema(decided.schema).parquet(out).where("po_id <> -1").select(
        "po_id", "period_ym", "approved", "balance_after")


@query("stream_asof_change", CHECKS["asof_each_row"], ROUNDED["asof_each_row"])
def stream_asof_change(t: Tables):
    """Prices in two deliveries, the later half first; a beat under a key of its own moves the watermark on."""
    feed = scratch_path(t.spark, "prices-feed")
    prices = t.commodity_prices.select("event_id", "input_key", "event_ts", "price_usd")
    half = timing.instant_like(prices, "event_ts", datetime(2024, 1, 16))
    sinks.append_sink(prices.where(F.col("event_ts") >= half), feed)
    sinks.append_sink(prices.where(F.col("event_ts") < half), feed)
    kinds = {c: prices.schema[c].dataType for c in prices.columns}
    beat = t.spark.range(1).select(*[
        F.lit(v).cast(kinds[c]).alias(c) for c, v in (
            ("event_id", "-1"), ("input_key", "-1"), ("event_ts", datetime(2100, 1, 1)), ("price_usd", None))])
    out = scratch_path(t.spark, "asof-changes")
    for late in (False, True):
        if late:
            sinks.append_sink(beat, feed)
        source = readers.stream_source(t.spark, feed, prices.schema)
        changed = asof.stream_asof_change(source, "input_key", "event_ts", "price_usd", timedelta(hours=1),
                                          lateness="60 days")
        feeds.append_to(changed, out, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.schema(changed.schema).parquet(out)


def _in_halves(t: Tables, feed: str, middle: datetime):
    """A feed in two deliveries, the later half first, one file a batch."""
    table, folder = getattr(t, feed), scratch_path(t.spark, f"{feed}-halves")
    late = F.col("event_ts") < timing.instant_like(table, "event_ts", middle)
    for part in (~late, late):
        sinks.append_sink(table.where(part).repartition(2), folder)
    return readers.stream_source(t.spark, folder, table.schema, max_files=1)


@query("stream_last_n", CHECKS["last_n_samples"], ROUNDED["last_n_samples"])
def stream_last_n(t: Tables):
    out = scratch_path(t.spark, "recent-prices")
    kept = recent.RecentSamples(t.spark, out, ["input_key"], 60, every=2)
    prices = _in_halves(t, "commodity_prices", datetime(2024, 1, 16)).select(
        "event_id", "input_key", "event_ts", "price_usd")
    kept.follow(prices, f"{out}-checkpoint").awaitTermination()
    return kept.read()


@query("stream_sparkline", CHECKS["sparkline_stats"], ROUNDED["sparkline_stats"])
def stream_sparkline(t: Tables):
    out = scratch_path(t.spark, "recent-readings")
    kept = recent.RecentSamples(t.spark, out, ["room_id", "sensor_type"], 40, every=2)
    readings = _in_halves(t, "iot_sensor_events", datetime(2024, 1, 16)).where("value IS NOT NULL")
    kept.follow(readings, f"{out}-checkpoint").awaitTermination()
    return aggregates.sparkline_stats(kept.read())


def _order_views(t: Tables) -> joined.OrderViews:
    """Orders, receipts and invoices in three deliveries each, read as three moving feeds."""
    out, sources, arriving = scratch_path(t.spark, "order-views"), {}, []
    for tag, name in (("orders", "purchase_orders"), ("receipts", "goods_receipts"), ("invoices", "invoice_documents")):
        table, folder = getattr(t, name), scratch_path(t.spark, name)
        sources[tag] = silver.validated(name, readers.stream_source(t.spark, folder, table.schema))
        arriving.append((table, folder))
    for year_from, year_to in ((1990, 1994), (1997, 2100), (1994, 1997)):   # the middle arrives last
        for table, folder in arriving:
            since, until = (timing.instant_like(table, "event_ts", datetime(y, 1, 1)) for y in (year_from, year_to))
            sinks.append_sink(table.where((F.col("event_ts") >= since) & (F.col("event_ts") < until)), folder)
        joined.stream_order_views(**sources, suppliers=t.dim_supplier, path=out,
                                  checkpoint=f"{out}-checkpoint").awaitTermination()
        for _, folder in arriving:      # taken in: the next delivery comes into an empty folder
            sinks.drop_delivered(t.spark, folder)
    return joined.OrderViews(t.spark, out)


@query("stream_po_lines", CHECKS["gd_open_po_lines"], ROUNDED["gd_open_po_lines"])
def stream_po_lines(t: Tables):
    return _order_views(t).lines.read().drop("event_id")


@query("stream_invoice_matching", CHECKS["gd_invoice_matching"], ROUNDED["gd_invoice_matching"])
def stream_invoice_matching(t: Tables):
    return _order_views(t).matches.read()


@query("stream_kpis", CHECKS["kpi_summary"], ROUNDED["kpi_summary"])
def stream_kpis(t: Tables):
    """Five feeds in two deliveries: older states first (for stock last), then what holds at `as_of`."""
    at, hour = timing.instant_like, timedelta(hours=1)
    stock, advice, drafts, inbox = (t.inventory_events, gold_views.recommended(t), t.po_drafts, t.email_inbox)
    rows = F.col("event_ts") < at(stock, "event_ts", datetime(2024, 1, 16))
    advice = cut_lineage(advice.select("recommendation_id", "created_ts", "decision", "total_cost_usd"), "advice")
    drafts = drafts.select(F.col("po_id").cast("string").alias("po_id"), F.col("created_ts").alias("changed_ts"), "status")
    inbox = inbox.select(F.col("email_id").cast("string").alias("email_id"), F.col("received_ts").alias("changed_ts"), "processed")
    prices = t.commodity_prices.where("price_usd > 0").select("event_id", "event_ts")
    deliveries = {
        "inventory": [stock.where(~rows), stock.where(rows)],
        "recommendations": [advice.withColumn("created_ts", F.col("created_ts") - F.lit(hour)), advice],
        "drafts": [drafts.withColumns({"changed_ts": F.col("changed_ts") - F.lit(hour), "status": F.lit("DRAFT")}), drafts],
        "inbox": [inbox.withColumns({"changed_ts": F.col("changed_ts") - F.lit(hour), "processed": F.lit(False)}), inbox],
        "prices": [prices],
    }
    sources, out = {}, scratch_path(t.spark, "dashboard")
    for feed, parts in deliveries.items():
        folder = scratch_path(t.spark, feed)
        for part in parts:
            sinks.append_sink(part.coalesce(1), folder)
        sources[feed] = readers.stream_source(t.spark, folder, parts[-1].schema, max_files=1)
    sources["inventory"] = silver.validated("inventory_events", sources["inventory"])
    board = dashboard.Dashboard(t.spark, out, t.dim_sku, every=2)
    board.follow(f"{out}-checkpoint", lambda: bindings.AS_OF_EVENTS, **sources).awaitTermination()
    return board.read(bindings.AS_OF_EVENTS)
