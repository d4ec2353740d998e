"""Parameterised reads with their default parameters."""

from __future__ import annotations

from harvestline.checks import gold as views
from harvestline.checks.registry import Tables, query
from harvestline.plans import serving
from harvestline.sources.bindings import AS_OF_EVENTS


@query("q_inventory", """
    SELECT sku, room_id, on_hand_g, last_event_ts, reorder_point_g, target_stock_g
    FROM gd_inventory_snapshot ORDER BY sku, room_id""")
def q_inventory(t: Tables):
    return serving.q_inventory(views.snapshot(t))


@query("q_leaderboard", """
    SELECT * REPLACE (R(usd_per_gram) AS usd_per_gram, R(score) AS score)
    FROM gd_supplier_leaderboard WHERE rank <= 5 ORDER BY sku, rank""", round_to=8)
def q_leaderboard(t: Tables):
    return serving.q_leaderboard(views.leaderboard(t, top=5))


@query("q_commodity", """
    SELECT input_key, price_usd, unit, event_ts, R(pct_1h) AS pct_1h, R(pct_24h) AS pct_24h
    FROM gd_commodity_latest ORDER BY input_key""")
def q_commodity(t: Tables):
    return serving.q_commodity(views.prices(t))


@query("q_demand", """
    SELECT sku, hour_ts, trays, R(grams_req) AS grams_req FROM gd_demand_1h
    WHERE hour_ts >= timestamp '2024-01-30 00:00:00' ORDER BY hour_ts, sku""", round_to=3)
def q_demand(t: Tables):
    return serving.q_demand(views.demand(t), AS_OF_EVENTS)


@query("q_recommendations", """
    SELECT recommendation_id, created_ts, sku, room_id, packs, decision, rationale
    FROM gd_recommendations WHERE decision = 'BUY_NOW'
    ORDER BY created_ts DESC, recommendation_id LIMIT 50""")
def q_recommendations(t: Tables):
    return serving.q_recommendations(views.recommended(t), decision="buy_now").select(
        "recommendation_id", "created_ts", "sku", "room_id", "packs", "decision", "rationale")


@query("q_iot", "SELECT * FROM gd_iot_latest ORDER BY room_id, sensor_type")
def q_iot(t: Tables):
    return serving.q_iot(views.sensors(t))


@query("q_po_lines", """
    SELECT * REPLACE (R(unit_price_usd) AS unit_price_usd, R(qty_received_g) AS qty_received_g,
                      R(qty_outstanding_g) AS qty_outstanding_g)
    FROM gd_open_po_lines WHERE po_status = 'OPEN'
    ORDER BY event_ts DESC, po_number, po_item LIMIT 100""", round_to=8)
def q_po_lines(t: Tables):
    return serving.q_po_lines(views.po_lines(t), status="open")


@query("q_invoice_matching", """
    SELECT invoice_doc_number, po_number, po_item, supplier_id, sku,
           R(net_amount_usd) AS net_amount_usd, po_net_value_usd, R(gr_qty_g) AS gr_qty_g,
           R(variance_usd) AS variance_usd, status, match_status, event_ts
    FROM gd_invoice_matching ORDER BY event_ts DESC, invoice_doc_number LIMIT 100""")
def q_invoice_matching(t: Tables):
    return serving.q_invoice_matching(views.matches(t))


@query("q_summary", """
    SELECT (SELECT count(*) FROM gd_inventory_snapshot WHERE on_hand_g <= reorder_point_g)
             AS skus_below_reorder,
           (SELECT count(*) FROM gd_recommendations WHERE decision = 'BUY_NOW')
             AS buy_now_last_5m,
           R((SELECT coalesce(sum(total_cost_usd), 0) FROM gd_recommendations))
             AS spend_pending_1h_usd,
           (SELECT max(event_ts) FROM gd_commodity_latest) AS last_market_tick,
           (SELECT count(*) FROM po_drafts WHERE status = 'DRAFT') AS po_drafts_open,
           (SELECT count(*) FROM email_inbox WHERE processed IS NOT TRUE)
             AS inbound_unprocessed""", round_to=2)
def q_summary(t: Tables):
    return serving.q_summary(views.snapshot(t), views.recommended(t), views.prices(t),
                             t.po_drafts, t.email_inbox, AS_OF_EVENTS)


@query("q_threads", "SELECT * FROM thread_state ORDER BY last_ts DESC, thread_id LIMIT 25")
def q_threads(t: Tables):
    return serving.q_threads(t.email_outbox, t.email_inbox)


@query("q_thread", """
    SELECT * FROM all_mail WHERE thread_id = (SELECT max(thread_id) FROM email_outbox)
    ORDER BY ts, email_id""")
def q_thread(t: Tables):
    newest = t.email_outbox.agg({"thread_id": "max"}).scalar()
    return serving.q_thread(t.email_outbox, t.email_inbox, newest)


@query("q_po_drafts", """
    SELECT * REPLACE (R(unit_price_usd) AS unit_price_usd) FROM po_drafts
    WHERE status = 'APPROVED' ORDER BY created_ts DESC, po_id LIMIT 50""")
def q_po_drafts(t: Tables):
    return serving.q_po_drafts(t.po_drafts, status="approved")


@query("q_budget", """
    SELECT ledger_id, entry_ts, period_ym, category, R(balance_usd) AS balance_usd,
           R((SELECT balance_usd FROM budget_ledger
              WHERE period_ym = '2001-07' AND category = 'SEED'
              ORDER BY entry_ts DESC, ledger_id LIMIT 1)) AS current_balance_usd
    FROM budget_ledger WHERE period_ym = '2001-07'
    ORDER BY entry_ts DESC, ledger_id LIMIT 20""")
def q_budget(t: Tables):
    return serving.q_budget(t.budget_ledger, "2001-07").select(
        "ledger_id", "entry_ts", "period_ym", "category", "balance_usd", "current_balance_usd")


@query("q_applications", """
    SELECT application_id, submitted_ts, supplier_name, country, status
    FROM supplier_applications WHERE status = 'NEW' ORDER BY submitted_ts DESC, application_id""")
def q_applications(t: Tables):
    return serving.q_applications(t.supplier_applications, status="new").select(
        "application_id", "submitted_ts", "supplier_name", "country", "status")


@query("q_invoices", """
    SELECT reconciliation_id, received_ts, po_id, R(invoiced_amount_usd) AS invoiced_amount_usd,
           status FROM invoice_reconciliations WHERE status = 'NEW'
    ORDER BY received_ts DESC, reconciliation_id LIMIT 100""")
def q_invoices(t: Tables):
    return serving.q_invoices(t.invoice_reconciliations, status="new").select(
        "reconciliation_id", "received_ts", "po_id", "invoiced_amount_usd", "status")


@query("q_runs", "SELECT * FROM agent_runs ORDER BY started_ts DESC, run_id LIMIT 50")
def q_runs(t: Tables):
    return serving.q_runs(t.agent_runs)
