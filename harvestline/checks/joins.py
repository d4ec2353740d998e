"""Joins and set operations over whole tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from harvestline.checks import gold as views
from harvestline.checks.registry import VIEWS, Tables, query
from harvestline.operators import aggregates, asof, joins, latest, quality
from harvestline.plans import serving, silver
from harvestline.sources.bindings import AS_OF_EVENTS, AS_OF_MAIL, BANDS, CROPS


@query("join_dim_left", """
    SELECT e.event_id, e.sku, d.sku_name, d.crop_type
    FROM inventory_events e LEFT JOIN dim_sku d USING (sku)""")
def join_dim_left(t: Tables):
    return joins.join_dim_left(t.inventory_events.select("event_id", "sku"), t.dim_sku, "sku",
                               ["sku_name", "crop_type"])


@query("join_composite_left", """
    SELECT p.event_id, p.po_number, p.po_item, R(r.got) AS qty_received_g
    FROM purchase_orders p LEFT JOIN receipt_totals r USING (po_number, po_item)""")
def join_composite_left(t: Tables):
    return joins.join_composite_left(
        t.purchase_orders.select("event_id", "po_number", "po_item"), t.goods_receipts)


@query("join_supplier_left", """
    SELECT p.event_id, p.supplier_id, s.supplier_name, s.tier AS supplier_tier
    FROM purchase_orders p LEFT JOIN dim_supplier s USING (supplier_id)""")
def join_supplier_left(t: Tables):
    return joins.join_supplier_left(
        t.purchase_orders.select("event_id", "supplier_id"), t.dim_supplier)


@query("asof_join", """
    SELECT room_id, sensor_type, arg_max(value, (event_ts, event_id)) AS ref_value
    FROM iot_sensor_events WHERE event_ts <= timestamp '2024-01-24 00:00:00' GROUP BY ALL""")
def asof_join(t: Tables):
    keyed = t.iot_sensor_events.withColumn("key", F.struct("room_id", "sensor_type"))
    found = asof.asof_value(keyed, "key", "event_ts", "value", AS_OF_EVENTS, days=7)
    return found.select("key.*", "ref_value")


@query("asof_multi", """
    SELECT input_key, arg_max(price_usd, (event_ts, event_id)) AS price_usd,
           max(event_ts) AS event_ts,
           arg_max(price_usd, (event_ts, event_id))
             FILTER (event_ts <= timestamp '2024-01-30 23:00:00') AS value_1h,
           arg_max(price_usd, (event_ts, event_id))
             FILTER (event_ts <= timestamp '2024-01-30 00:00:00') AS value_24h
    FROM commodity_prices GROUP BY input_key""")
def asof_multi(t: Tables):
    return asof.asof_multi(t.commodity_prices, "input_key", "event_ts", "price_usd",
                           AS_OF_EVENTS, [1, 24])


@query("asof_each_row", """
    SELECT e.event_id, e.input_key, e.event_ts, e.price_usd, p.price_usd AS ref_value,
           R((e.price_usd - p.price_usd) / nullif(p.price_usd, 0)) AS pct
    FROM commodity_prices e ASOF LEFT JOIN commodity_prices p
      ON e.input_key = p.input_key AND e.event_ts - INTERVAL 1 HOUR >= p.event_ts""")
def asof_each_row(t: Tables):
    prices = t.commodity_prices.select("event_id", "input_key", "event_ts", "price_usd")
    return asof.asof_change(prices, "input_key", "event_ts", "price_usd", timedelta(hours=1))


@query("join_thresholds", """
    SELECT event_id, sensor_type, value, alert_min, warn_min,
           CASE WHEN value < alert_min OR value > alert_max THEN 'ALERT'
                WHEN value < warn_min OR value > warn_max THEN 'CAUTION'
                ELSE 'NOMINAL' END AS status
    FROM iot_sensor_events LEFT JOIN sensor_bands USING (sensor_type)""")
def join_thresholds(t: Tables):
    return joins.join_thresholds(
        t.iot_sensor_events.select("event_id", "sensor_type", "value"), BANDS
    ).select("event_id", "sensor_type", "value", "alert_min", "warn_min", "status")


@query("three_way_match", """
    SELECT i.event_id, i.po_number, i.po_item, p.net_value_usd AS po_net_value_usd,
           R(coalesce(r.got, 0)) AS gr_qty_g,
           CASE WHEN p.net_value_usd IS NULL THEN 'NO_PO'
                WHEN coalesce(r.got, 0) = 0 THEN 'PENDING_GR'
                WHEN abs(i.variance_usd) <= p.net_value_usd * 0.02 THEN 'MATCHED'
                ELSE 'VARIANCE' END AS match_status
    FROM invoice_documents i LEFT JOIN po_latest p USING (po_number, po_item)
    LEFT JOIN receipt_totals r USING (po_number, po_item)""")
def three_way_match(t: Tables):
    return joins.three_way_match(
        t.invoice_documents, joins.line_state(
            silver.validated("purchase_orders", t.purchase_orders),
            silver.deduplicated("goods_receipts", t.goods_receipts, views.RECEIPT))
    ).select("event_id", "po_number", "po_item", "po_net_value_usd", "gr_qty_g", "match_status")


@query("map_join_left", """
    SELECT sku, crop_type, input_key FROM dim_sku LEFT JOIN crop_inputs USING (crop_type)""")
def map_join_left(t: Tables):
    return joins.map_join_left(t.dim_sku.select("sku", "crop_type"), CROPS)


@query("trend_fanout", "SELECT sku, R(input_pct_24h) AS input_pct_24h FROM sku_trend")
def trend_fanout(t: Tables):
    return views.trend(t)


@query("feature_join", """
    SELECT sku, supplier_id, supplier_name, R(on_time_pct) AS on_time_pct,
           R(quality_score) AS quality_score, R(organic_cert_int) AS organic_cert_int,
           cast(demand_1h_trays AS bigint) AS demand_1h_trays,
           R(input_pct_24h) AS input_pct_24h FROM supplier_features""")
def feature_join(t: Tables):
    return views.features(t).select(
        "sku", "supplier_id", "supplier_name", "on_time_pct", "quality_score",
        "organic_cert_int", "demand_1h_trays", "input_pct_24h")


@query("low_stock_best", """
    SELECT sku, room_id, supplier_id, R(score) AS score, R(input_pct_24h) AS input_pct_24h
    FROM low_offers""")
def low_stock_best(t: Tables):
    best = views.leaderboard(t, top=1).select("sku", "supplier_id", "score")
    return joins.low_stock_best(
        quality.below_reorder(views.snapshot(t)), views.trend(t), best
    ).select("sku", "room_id", "supplier_id", "score", "input_pct_24h")


@query("thread_rfq_join", """
    SELECT i.email_id, i.thread_id, o.email_id AS rfq_email_id, o.sku AS out_sku,
           o.supplier_id AS out_supplier
    FROM email_inbox i JOIN email_outbox o ON o.thread_id = i.thread_id AND o.intent = 'RFQ'""")
def thread_rfq_join(t: Tables):
    return joins.thread_rfq_join(t.email_inbox.select("email_id", "thread_id"), t.email_outbox)


@query("anti_join_theta", """
    SELECT event_id, sku, supplier_id FROM supplier_quotes q WHERE NOT EXISTS (
      SELECT 1 FROM email_outbox o WHERE o.sku = q.sku AND o.supplier_id = q.supplier_id
        AND o.intent = 'RFQ' AND o.created_ts > timestamp '2023-12-31 00:10:00')""")
def anti_join_theta(t: Tables):
    quotes = t.supplier_quotes.select("event_id", "sku", "supplier_id")
    return joins.without_recent_rfq(quotes, t.email_outbox, AS_OF_MAIL, "supplier_id")


@query("anti_join", """
    SELECT email_id, thread_id FROM email_inbox i
    WHERE NOT EXISTS (SELECT 1 FROM po_drafts p WHERE p.thread_id = i.thread_id)""")
def anti_join(t: Tables):
    return joins.without(t.email_inbox.select("email_id", "thread_id"), t.po_drafts, "thread_id")


@query("semi_lookup", """
    SELECT po_id, supplier_id FROM po_drafts p
    WHERE EXISTS (SELECT 1 FROM invoice_reconciliations r WHERE r.po_id = p.po_id)""")
def semi_lookup(t: Tables):
    return joins.having(t.po_drafts.select("po_id", "supplier_id"), t.invoice_reconciliations,
                        "po_id")


@query("latest_lookup", """
    SELECT po_id, d.sku, R(r.reorder_grams) AS rec_grams, r.packs AS rec_packs
    FROM po_drafts d LEFT JOIN (
      SELECT sku, reorder_grams, packs FROM gd_recommendations QUALIFY row_number() OVER (
        PARTITION BY sku ORDER BY created_ts DESC, recommendation_id DESC) = 1) r USING (sku)""")
def latest_lookup(t: Tables):
    return joins.latest_recommendation(t.po_drafts.select("po_id", "sku"), views.recommended(t))


@query("pk_lookup", """
    SELECT reconciliation_id, po_id, p.total_cost_usd AS expected_total
    FROM invoice_reconciliations LEFT JOIN po_drafts p USING (po_id)""")
def pk_lookup(t: Tables):
    return t.invoice_reconciliations.select("reconciliation_id", "po_id").join(
        t.po_drafts.select("po_id", F.col("total_cost_usd").alias("expected_total")),
        "po_id", "left")


@query("scalar_subqueries", """
    SELECT (SELECT count(*) FROM po_drafts WHERE status = 'DRAFT') AS drafts,
           (SELECT max(event_ts) FROM commodity_prices) AS last_tick,
           (SELECT count(*) FROM email_inbox WHERE processed IS NOT TRUE) AS mail""")
def scalar_subqueries(t: Tables):
    n = F.count(F.lit(1))
    return t.po_drafts.where("status = 'DRAFT'").agg(n.alias("drafts")).select(
        "drafts",
        t.commodity_prices.agg(F.max("event_ts")).scalar().alias("last_tick"),
        quality.unprocessed(t.email_inbox).agg(n).scalar().alias("mail"))


# ---- set operations ---------------------------------------------------------------

VIEWS["all_mail"] = """
    SELECT email_id, thread_id, created_ts AS ts, supplier_id, supplier_email, subject, body_md,
           sku, intent, sent_by, status, 'OUT' AS side FROM email_outbox
    UNION ALL
    SELECT email_id, thread_id, received_ts, supplier_id, supplier_email, subject, body_md, sku,
           intent_detected, NULL, NULL, 'IN' FROM email_inbox"""
VIEWS["thread_state"] = """
    SELECT thread_id, ts AS last_ts, supplier_id, supplier_email, sku, subject, intent, side
    FROM all_mail QUALIFY row_number() OVER (
      PARTITION BY thread_id ORDER BY ts DESC, side DESC, email_id DESC) = 1"""


@query("thread_rollup", "SELECT * FROM thread_state")
def thread_rollup(t: Tables):
    return serving.thread_rollup(t.email_outbox, t.email_inbox)


@query("thread_messages", "SELECT * FROM all_mail")
def thread_messages(t: Tables):
    return serving.thread_messages(t.email_outbox, t.email_inbox)


# ---- sorts and limits -------------------------------------------------------------


@query("top_k_recent", """
    SELECT event_id, event_ts, sku FROM inventory_events
    ORDER BY event_ts DESC, event_id LIMIT 100""")
def top_k_recent(t: Tables):
    return latest.newest_first(t.inventory_events.select("event_id", "event_ts", "sku"),
                               "event_ts", ["event_id"], 100)


@query("bottom_k_low_stock", """
    SELECT sku, room_id, on_hand_g, reorder_point_g FROM gd_inventory_snapshot
    WHERE on_hand_g <= reorder_point_g ORDER BY on_hand_g, sku, room_id LIMIT 10""")
def bottom_k_low_stock(t: Tables):
    return serving.bottom_k_low_stock(views.snapshot(t)).select(
        "sku", "room_id", "on_hand_g", "reorder_point_g")


@query("oldest_batch", """
    SELECT email_id, received_ts FROM email_inbox WHERE processed IS NOT TRUE
    ORDER BY received_ts, email_id LIMIT 20""")
def oldest_batch(t: Tables):
    return latest.oldest_batch(
        quality.unprocessed(t.email_inbox).select("email_id", "received_ts"),
        "received_ts", ["email_id"], 20)


@query("multi_key_sort", """
    SELECT sku, room_id, event_ts FROM inventory_events ORDER BY sku, room_id, event_ts""")
def multi_key_sort(t: Tables):
    return aggregates.multi_key_sort(
        t.inventory_events.select("sku", "room_id", "event_ts"), ["sku", "room_id", "event_ts"])
