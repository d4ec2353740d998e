"""Aggregates and windows over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestline.checks import gold as views
from harvestline.checks.registry import VIEWS, Tables, query
from harvestline.functions import timing
from harvestline.operators import aggregates, asof, budget, latest
from harvestline.plans import silver, workflow
from harvestline.sources.bindings import AS_OF_EVENTS, PERIOD_BUDGET_USD


@query("receipts_sum", "SELECT po_number, po_item, R(got) AS qty_received_g FROM receipt_totals")
def receipts_sum(t: Tables):
    return aggregates.receipts_sum(t.goods_receipts)


@query("demand_total", """
    SELECT sku, cast(sum(trays) AS bigint) AS demand_1h_trays FROM sv_demand_events
    GROUP BY sku""")
def demand_total(t: Tables):
    return aggregates.demand_total(views.demand(t))


@query("demand_tumbling_1h", """
    SELECT sku, hour_ts, trays, R(grams_req) AS grams_req FROM gd_demand_1h""", round_to=3)
def demand_tumbling_1h(t: Tables):
    return aggregates.demand_tumbling(silver.deduplicated("demand_events", t.demand_events))


@query("max_before", """
    SELECT input_key, max(event_ts) AS ref_ts FROM commodity_prices
    WHERE event_ts <= timestamp '2024-01-30 00:00:00' GROUP BY input_key""")
def max_before(t: Tables):
    return asof.max_before(t.commodity_prices, "input_key", "event_ts", AS_OF_EVENTS, hours=24)


@query("kpi_summary", """
    SELECT (SELECT count(*) FROM gd_inventory_snapshot WHERE on_hand_g <= reorder_point_g)
             AS skus_below_reorder,
           (SELECT count(*) FROM gd_recommendations WHERE decision = 'BUY_NOW'
              AND created_ts > timestamp '2024-01-30 23:55:00') AS buy_now_last_5m,
           R((SELECT coalesce(sum(total_cost_usd), 0) FROM gd_recommendations
              WHERE created_ts > timestamp '2024-01-30 23:00:00')) AS spend_pending_1h_usd,
           (SELECT max(event_ts) FROM gd_commodity_latest) AS last_market_tick,
           (SELECT count(*) FROM po_drafts WHERE status = 'DRAFT') AS po_drafts_open,
           (SELECT count(*) FROM email_inbox WHERE processed IS NOT TRUE)
             AS inbound_unprocessed""", round_to=2)
def kpi_summary(t: Tables):
    return aggregates.kpi_summary(views.snapshot(t), views.recommended(t), views.prices(t),
                                  t.po_drafts, t.email_inbox, AS_OF_EVENTS)


@query("distinct_values", "SELECT DISTINCT status FROM po_drafts")
def distinct_values(t: Tables):
    return aggregates.distinct_values(t.po_drafts, "status")


@query("count_distinct", """
    SELECT count(*) AS total, count(DISTINCT invoice_doc_number) AS uniq FROM invoice_documents""")
def count_distinct(t: Tables):
    return aggregates.count_distinct(t.invoice_documents, "invoice_doc_number")


@query("demand_by_hour_label", """
    SELECT strftime(hour_ts, '%H') AS hour, cast(sum(trays) AS bigint) AS trays
    FROM gd_demand_1h GROUP BY ALL""")
def demand_by_hour_label(t: Tables):
    return aggregates.demand_by_hour_label(views.demand(t))


VIEWS["room_state"] = """
    SELECT room_id, CASE WHEN alerts > 0 THEN 'ALERT' WHEN cautions > 0 THEN 'CAUTION'
                    ELSE 'NOMINAL' END AS room_status, alerts, cautions, last_ts
    FROM (SELECT room_id, count(*) FILTER (status = 'ALERT') AS alerts,
                 count(*) FILTER (status = 'CAUTION') AS cautions, max(event_ts) AS last_ts
          FROM gd_iot_latest GROUP BY room_id)"""


@query("room_status", "SELECT * FROM room_state")
def room_status(t: Tables):
    return aggregates.room_status(views.sensors(t))


@query("farm_overview", """
    SELECT count(*) AS rooms, count(*) FILTER (room_status = 'ALERT') AS alert_rooms,
           count(*) FILTER (room_status = 'CAUTION') AS caution_rooms,
           count(*) FILTER (room_status = 'NOMINAL') AS nominal_rooms FROM room_state""")
def farm_overview(t: Tables):
    return aggregates.farm_overview(views.sensors(t))


@query("sparkline_stats", """
    SELECT room_id, sensor_type, min(value) AS low, max(value) AS high, count(*) AS samples,
           R(CASE WHEN max(value) = min(value) THEN 1 ELSE max(value) - min(value) END) AS spread
    FROM (SELECT * FROM iot_sensor_events QUALIFY row_number() OVER (
            PARTITION BY room_id, sensor_type ORDER BY event_ts DESC, event_id DESC) <= 40)
    GROUP BY ALL""")
def sparkline_stats(t: Tables):
    return aggregates.sparkline_stats(t.iot_sensor_events)


@query("global_mean_norm", """
    SELECT event_id, R(price_usd / (SELECT avg(price_usd) FROM commodity_prices)) AS price_norm
    FROM commodity_prices""")
def global_mean_norm(t: Tables):
    return aggregates.global_mean_norm(
        t.commodity_prices.select("event_id", "price_usd"), "price_usd", "price_norm"
    ).drop("price_usd")


@query("unique_suppliers", """
    SELECT supplier_id, supplier_name, sku, rank FROM gd_supplier_leaderboard
    QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY sku DESC, rank DESC) = 1""")
def unique_suppliers(t: Tables):
    return aggregates.unique_suppliers(views.leaderboard(t))


@query("mae", """
    SELECT R(avg(abs(invoiced_amount_usd - expected))) AS mae FROM judged_invoices
    WHERE expected IS NOT NULL""", round_to=4)
def mae(t: Tables):
    drafts = t.po_drafts.select("po_id", "total_cost_usd")
    return aggregates.mean_absolute_error(
        t.invoice_reconciliations.join(drafts, "po_id"), "total_cost_usd", "invoiced_amount_usd")


# ---- windows ----------------------------------------------------------------------


@query("latest_per_key", f"""
    SELECT event_id, po_number, po_item, event_ts FROM purchase_orders
    {views.newest('po_number, po_item')}""")
def latest_per_key(t: Tables):
    return latest.latest_per_key(
        t.purchase_orders.select("event_id", "po_number", "po_item", "event_ts"),
        ["po_number", "po_item"])


@query("score_rank", "SELECT sku, supplier_id, rank FROM gd_supplier_leaderboard")
def score_rank(t: Tables):
    return views.leaderboard(t).select("sku", "supplier_id", "rank")


@query("top_n_per_group", """
    SELECT sku, supplier_id, R(score) AS score, rank FROM gd_supplier_leaderboard
    WHERE rank <= 5""")
def top_n_per_group(t: Tables):
    return views.leaderboard(t, top=5).select("sku", "supplier_id", "score", "rank")


@query("distinct_on", """
    SELECT DISTINCT ON (thread_id) thread_id, email_id, received_ts, intent_detected
    FROM email_inbox WHERE intent_detected IN ('QUOTE', 'ACCEPT', 'COUNTER')
    ORDER BY thread_id, received_ts DESC, email_id DESC""")
def distinct_on(t: Tables):
    usable = t.email_inbox.where("intent_detected IN ('QUOTE', 'ACCEPT', 'COUNTER')")
    return latest.latest_per_key(usable, ["thread_id"], "received_ts", ["email_id"]).select(
        "thread_id", "email_id", "received_ts", "intent_detected")


@query("pct_vs_baseline", """
    SELECT event_id, input_key, baseline,
           R((price_usd - baseline) / baseline * 100) AS pct_vs_base
    FROM commodity_prices LEFT JOIN (
      SELECT input_key, arg_min(price_usd, (event_ts, event_id)) AS baseline
      FROM commodity_prices WHERE price_usd <> 0 GROUP BY input_key) USING (input_key)""",
       round_to=4)
def pct_vs_baseline(t: Tables):
    return asof.pct_vs_baseline(
        t.commodity_prices.select("event_id", "input_key", "event_ts", "price_usd"),
        "input_key", "event_ts", "price_usd").drop("event_ts", "price_usd")


@query("last_n_samples", """
    SELECT event_id, input_key, event_ts, price_usd FROM commodity_prices
    QUALIFY row_number() OVER (PARTITION BY input_key ORDER BY event_ts DESC, event_id DESC)
            <= 60""")
def last_n_samples(t: Tables):
    return latest.last_n_samples(
        t.commodity_prices.select("event_id", "input_key", "event_ts", "price_usd"),
        ["input_key"], 60)


@query("current_balance", """
    SELECT period_ym, category, R(balance_usd) AS balance_usd, entry_ts FROM budget_ledger QUALIFY row_number()
      OVER (PARTITION BY period_ym, category ORDER BY entry_ts DESC, ledger_id DESC) = 1""")
def current_balance(t: Tables):
    return workflow.current_balance(t.budget_ledger)


# The walk below advances all periods together: step n takes row n of each.
VIEWS["budget_walk"] = """
    SELECT n, period, po_id, cost, left_before, cost <= left_before AS approved,
           CASE WHEN cost <= left_before THEN left_before - cost ELSE left_before END AS left_after
    FROM (SELECT n, period, po_id, cost, cast(2000000 AS double) AS left_before
          FROM ordered_drafts WHERE n = 1)
    UNION ALL
    SELECT o.n, o.period, o.po_id, o.cost, w.left_after, o.cost <= w.left_after,
           CASE WHEN o.cost <= w.left_after THEN w.left_after - o.cost ELSE w.left_after END
    FROM budget_walk w JOIN ordered_drafts o ON o.period = w.period AND o.n = w.n + 1"""
VIEWS["ordered_drafts"] = """
    SELECT po_id, strftime(created_ts, '%Y-%m') AS period, coalesce(total_cost_usd, 0) AS cost,
           row_number() OVER (PARTITION BY strftime(created_ts, '%Y-%m')
                              ORDER BY created_ts, po_id) AS n
    FROM po_drafts"""


@query("greedy_budget", """
    SELECT po_id, period, approved, CASE WHEN approved THEN R(left_after) END AS balance_after
    FROM budget_walk""", round_to=2)
def greedy_budget(t: Tables):
    drafts = t.po_drafts.select(
        "po_id", "created_ts", "total_cost_usd",
        timing.period_ym(F.col("created_ts")).alias("period"))
    budgets = drafts.select("period").distinct().withColumn(
        "balance_usd", F.lit(PERIOD_BUDGET_USD))
    return budget.greedy_allocate(
        drafts, budgets, ["period"], ["created_ts", "po_id"], "total_cost_usd"
    ).select("po_id", "period", "approved", "balance_after")
