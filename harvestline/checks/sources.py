"""Sources, sinks and state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestline import schemas
from harvestline.checks.registry import Tables, query, sql_id
from harvestline.functions import timing
from harvestline.operators import aggregates, joins, state
from harvestline.session import scratch_path
from harvestline.sources import bindings, readers, sinks

PRICE_WIRE = schemas.table(
    "event_id string, event_ts timestamp, input_key string, price_usd double")


@query("batch_source", "SELECT user_id, event_type, value FROM events")
def batch_source(t: Tables):
    return readers.batch_source(t.spark, t.folder, "events").select(
        "user_id", "event_type", "value")


@query("dim_source", "SELECT sku, crop_type, R(reorder_point_g) AS reorder_point_g FROM dim_sku")
def dim_source(t: Tables):
    return t.dim_sku.select("sku", "crop_type", "reorder_point_g")


@query("inline_table", """
    SELECT crop_type, input_key, count(*) AS skus
    FROM dim_sku JOIN (VALUES ('ECONOMY', 'click'), ('MEDIUM', 'view'), ('SMALL', 'purchase'),
                       ('LARGE', 'signup'), ('STANDARD', 'error')) m(crop_type, input_key)
    USING (crop_type) GROUP BY ALL""")
def inline_table(t: Tables):
    crops = joins.inline_table(t.spark, bindings.CROPS, "crop_type string, input_key string")
    return t.dim_sku.join(crops, "crop_type").groupBy("crop_type", "input_key").agg(
        F.count(F.lit(1)).alias("skus"))


@query("json_event_decode", """
    SELECT cast(event_id AS varchar) AS event_id, event_ts, input_key, price_usd
    FROM commodity_prices""")
def json_event_decode(t: Tables):
    wire = readers.with_instants(t.commodity_prices).select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"),
        F.unix_micros("event_ts").alias("event_ts"), "input_key", "price_usd",
    )).alias("value"))
    return readers.json_event_decode(wire, "value", PRICE_WIRE)


@query("append_sink", """
    SELECT po_id, created_ts, total_cost_usd, status FROM po_drafts""")
def append_sink(t: Tables):
    path = scratch_path(t.spark, "append")
    drafts = t.po_drafts.select("po_id", "created_ts", "total_cost_usd", "status")
    for status in ("DRAFT", "APPROVED", "REJECTED"):
        sinks.append_sink(drafts.where(F.col("status") == status), path)
    return t.spark.read.parquet(path)


@query("dim_upsert", """
    WITH incoming AS (
      SELECT supplier_id + (SELECT count(*) FROM dim_supplier) // 2 AS supplier_id,
             'new ' || supplier_name AS supplier_name, tier, on_time_pct, quality_score,
             organic_cert
      FROM dim_supplier)
    SELECT supplier_id, supplier_name, tier, R(on_time_pct) AS on_time_pct,
           R(quality_score) AS quality_score, organic_cert
    FROM (SELECT * FROM incoming UNION ALL
          SELECT * FROM dim_supplier
          WHERE supplier_id NOT IN (SELECT supplier_id FROM incoming))""")
def dim_upsert(t: Tables):
    current = t.dim_supplier
    half = F.floor(current.agg(F.count(F.lit(1))).scalar() / 2)
    incoming = current.withColumns({
        "supplier_id": F.col("supplier_id") + half,
        "supplier_name": F.concat(F.lit("new "), F.col("supplier_name")),
    })
    return state.dim_upsert(current, incoming, "supplier_id")


@query("state_update", """
    SELECT po_id, CASE WHEN total_cost_usd > 250000 THEN 'REJECTED' ELSE status END AS status,
           CASE WHEN total_cost_usd > 250000 THEN rationale || ' | BUDGET_EXCEEDED'
                ELSE rationale END AS rationale
    FROM po_drafts""")
def state_update(t: Tables):
    from harvestline.functions import text

    drafts = t.po_drafts.select("po_id", "status", "rationale", "total_cost_usd")
    delta = drafts.where("total_cost_usd > 250000").select(
        "po_id", F.lit("REJECTED").alias("status"),
        text.append_reason(F.col("rationale")).alias("rationale"))
    return state.state_update(drafts, delta, "po_id", ["status", "rationale"]).drop(
        "total_cost_usd")


@query("materialise", """
    SELECT sku, date_trunc('hour', event_ts) AS hour_ts, cast(sum(trays) AS bigint) AS trays,
           R(sum(grams_req)) AS grams_req
    FROM demand_events GROUP BY ALL""", round_to=3)
def materialise(t: Tables):
    hourly = aggregates.demand_tumbling(t.demand_events)
    return sinks.materialise(hourly, scratch_path(t.spark, "demand_1h"))


@query("snapshot_sync", """
    SELECT sku, room_id, on_hand_g, last_event_ts, reorder_point_g, target_stock_g
    FROM gd_inventory_snapshot""")
def snapshot_sync(t: Tables):
    from harvestline.plans import gold

    _, keys, _ = schemas.SERVING["gd_inventory_snapshot"]
    target = scratch_path(t.spark, "inventory_snapshot")
    sinks.snapshot_sync(gold.inventory_snapshot(t.inventory_events, t.dim_sku), target, keys)
    return t.spark.read.parquet(target).select(
        "sku", "room_id", "on_hand_g", "last_event_ts", "reorder_point_g", "target_stock_g")


@query("row_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS n FROM {name}"
    for name in schemas.FEEDS))
def row_counts(t: Tables):
    return aggregates.row_counts({name: getattr(t, name) for name in schemas.FEEDS})


@query("run_log", f"""
    SELECT {sql_id('RUN', "'invoice_reconciler'", 'reconciliation_id', "'2024-01-31T00:00:00'")} AS run_id,
           timestamp '2024-01-31 00:00:00' AS started_ts,
           timestamp '2024-01-31 00:00:00' AS finished_ts,
           'invoice_reconciler' AS agent_name,
           cast(reconciliation_id AS varchar) AS input_ref, status AS output_ref,
           cast(0 AS integer) AS prompt_tokens, cast(0 AS integer) AS output_tokens,
           'OK' AS status, cast(NULL AS varchar) AS error_msg
    FROM invoice_reconciliations""")
def run_log(t: Tables):
    return state.run_log(t.invoice_reconciliations, "invoice_reconciler",
                         bindings.AS_OF_EVENTS, input_ref=F.col("reconciliation_id"),
                         output_ref=F.col("status"))


@query("ingest_ts", "SELECT event_id, input_key, true AS stamped FROM commodity_prices")
def ingest_ts(t: Tables):
    stamped = timing.ingest_ts(t.commodity_prices)
    return stamped.select("event_id", "input_key",
                          (F.col("ingest_ts") <= F.current_timestamp()).alias("stamped"))
