"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestline.checks import gold as views
from harvestline.checks.registry import VIEWS, Tables, query, sql_id
from harvestline.functions import numbers, status, text, timing
from harvestline.operators import state
from harvestline.sources.bindings import BANDS


@query("unit_price_norm", """
    SELECT event_id, R(unit_price_usd / pack_size_g) AS usd_per_gram FROM supplier_quotes""",
       round_to=8)
def unit_price_norm(t: Tables):
    price = numbers.unit_price(F.col("unit_price_usd"), F.col("pack_size_g"))
    return t.supplier_quotes.select("event_id", price.alias("usd_per_gram"))


@query("pct_change", """
    SELECT ledger_id, CASE WHEN delta_usd <> 0 THEN R((balance_usd - delta_usd) / delta_usd) END
                      AS pct FROM budget_ledger""")
def pct_change(t: Tables):
    return t.budget_ledger.select(
        "ledger_id", numbers.pct_change(F.col("balance_usd"), F.col("delta_usd")).alias("pct"))


@query("clamp_floor", """
    SELECT sku, room_id, R(greatest(target_stock_g - on_hand_g, 0)) AS reorder_grams
    FROM gd_inventory_snapshot""")
def clamp_floor(t: Tables):
    return views.snapshot(t).select("sku", "room_id", numbers.shortfall(
        F.col("target_stock_g"), F.col("on_hand_g")).alias("reorder_grams"))


@query("packs_ceil", """
    SELECT event_id, cast(ceil(min_qty * cast(17 AS double) / pack_size_g) AS integer) AS packs
    FROM supplier_quotes""")
def packs_ceil(t: Tables):
    packs = numbers.packs_up(F.col("min_qty") * 17.0, F.col("pack_size_g"))
    return t.supplier_quotes.select("event_id", packs.alias("packs"))


@query("packs_trunc", """
    SELECT event_id, cast(greatest(CASE
             WHEN trunc(min_qty * cast(17 AS double) / pack_size_g) > 0
               THEN trunc(min_qty * cast(17 AS double) / pack_size_g)
             WHEN lead_time_days % 3 <> 0 THEN lead_time_days % 3 ELSE 10 END, 1) AS integer)
           AS packs
    FROM supplier_quotes""")
def packs_trunc(t: Tables):
    packs = numbers.packs_down(F.col("min_qty") * 17.0, F.col("pack_size_g"),
                               F.col("lead_time_days") % 3)
    return t.supplier_quotes.select("event_id", packs.alias("packs"))


@query("bool_to_num", """
    SELECT event_id, CASE WHEN organic THEN cast(1 AS double) ELSE cast(0 AS double) END AS organic
    FROM supplier_quotes""")
def bool_to_num(t: Tables):
    return t.supplier_quotes.select("event_id", numbers.flag(F.col("organic")).alias("organic"))


@query("fill_defaults", """
    SELECT sku, R(coalesce(on_hand_g, 0.85)) AS on_hand_g,
           coalesce(room_id, 'none') AS room_id, crop_type
    FROM dim_sku LEFT JOIN (SELECT sku, room_id, on_hand_g FROM gd_inventory_snapshot) USING (sku)
    """)
def fill_defaults(t: Tables):
    stock = views.snapshot(t).select("sku", "room_id", "on_hand_g")
    joined = t.dim_sku.select("sku", "crop_type").join(stock, "sku", "left")
    return state.fill_defaults(joined, {"on_hand_g": 0.85, "room_id": "none"})


@query("rationale_text", "SELECT recommendation_id, rationale FROM gd_recommendations")
def rationale_text(t: Tables):
    return views.recommended(t).select("recommendation_id", "rationale")


@query("rec_id", """
    SELECT event_id, concat_ws('-', sku, room_id, strftime(event_ts, '%Y%m%d%H%M%S')) AS rec_id
    FROM inventory_events""")
def rec_id(t: Tables):
    return t.inventory_events.select("event_id", text.recommendation_id(
        F.col("sku"), F.col("room_id"), F.col("event_ts")).alias("rec_id"))


@query("decision_case", "SELECT sku, room_id, decision FROM gd_recommendations")
def decision_case(t: Tables):
    return views.recommended(t).select("sku", "room_id", "decision")


@query("po_status_case", "SELECT po_number, po_item, po_status FROM gd_open_po_lines")
def po_status_case(t: Tables):
    return views.po_lines(t).select("po_number", "po_item", "po_status")


@query("match_status_case", "SELECT invoice_doc_number, match_status FROM gd_invoice_matching")
def match_status_case(t: Tables):
    return views.matches(t).select("invoice_doc_number", "match_status")


@query("iot_status_case", """
    SELECT event_id, CASE WHEN value < 20 OR value > 300 THEN 'ALERT'
                          WHEN value < 50 OR value > 200 THEN 'CAUTION' ELSE 'NOMINAL' END
                     AS status FROM iot_sensor_events""")
def iot_status_case(t: Tables):
    _, alert_min, alert_max, warn_min, warn_max, _, _ = BANDS[0]
    return t.iot_sensor_events.select("event_id", status.sensor_status(
        F.col("value"), *[F.lit(b) for b in (alert_min, alert_max, warn_min, warn_max)]
    ).alias("status"))


VIEWS["judged_invoices"] = """
    SELECT *, CASE WHEN expected IS NULL OR expected = 0 THEN billed ELSE billed - expected END
                AS variance,
           CASE WHEN expected IS NULL OR expected = 0 THEN 100
                ELSE abs(billed - expected) / expected * 100 END AS pct
    FROM (SELECT r.*, coalesce(r.invoiced_amount_usd, 0) AS billed,
                 p.total_cost_usd AS expected
          FROM invoice_reconciliations r LEFT JOIN po_drafts p USING (po_id))"""


def _judged(t: Tables):
    drafts = t.po_drafts.select("po_id", F.col("total_cost_usd").alias("expected"))
    return t.invoice_reconciliations.join(drafts, "po_id", "left")


@query("recon_case", """
    SELECT reconciliation_id,
           CASE WHEN expected IS NULL OR expected = 0 THEN 'DISPUTE' WHEN pct <= 1 THEN 'OK'
                WHEN pct <= 5 THEN 'REVIEW' ELSE 'DISPUTE' END AS status FROM judged_invoices""")
def recon_case(t: Tables):
    pct = numbers.invoice_variance_pct(F.col("invoiced_amount_usd"), F.col("expected"))
    return _judged(t).select("reconciliation_id", status.reconcile_status(
        pct, numbers.has_total(F.col("expected"))).alias("status"))


@query("outstanding", """
    SELECT po_number, po_item, R(qty_outstanding_g) AS qty_outstanding_g
    FROM gd_open_po_lines""")
def outstanding(t: Tables):
    return views.po_lines(t).select("po_number", "po_item", "qty_outstanding_g")


@query("abs_pct_variance", """
    SELECT reconciliation_id, R(variance) AS variance_usd, R(pct) AS variance_pct
    FROM judged_invoices""")
def abs_pct_variance(t: Tables):
    billed, expected = F.col("invoiced_amount_usd"), F.col("expected")
    return _judged(t).select(
        "reconciliation_id",
        numbers.invoice_variance(billed, expected).alias("variance_usd"),
        numbers.invoice_variance_pct(billed, expected).alias("variance_pct"))


@query("needed_by", """
    SELECT event_id, cast(event_ts AS date) + CASE WHEN lead_time_days % 4 = 0 THEN 7
                                              ELSE lead_time_days % 4 END AS needed_by
    FROM supplier_quotes""")
def needed_by(t: Tables):
    return t.supplier_quotes.select("event_id", timing.needed_by(
        F.col("event_ts"), F.col("lead_time_days") % 4).alias("needed_by"))


@query("period_ym", """
    SELECT po_id, strftime(created_ts, '%Y-%m') AS period_ym FROM po_drafts""")
def period_ym(t: Tables):
    return t.po_drafts.select("po_id", timing.period_ym(F.col("created_ts")).alias("period_ym"))


@query("email_slug", """
    SELECT supplier_id, 'orders@' || replace(split_part(lower('O''' || supplier_name || ' Farms'),
                                                        ' ', 1), '''', '') || '.demo' AS email
    FROM dim_supplier
    UNION ALL SELECT -supplier_id, 'orders@' || supplier_id || '.demo' FROM dim_supplier""")
def email_slug(t: Tables):
    named = t.dim_supplier.select("supplier_id", text.order_address(
        F.concat(F.lit("O'"), F.col("supplier_name"), F.lit(" Farms")),
        F.col("supplier_id")).alias("email"))
    unnamed = t.dim_supplier.select(
        (-F.col("supplier_id")).alias("supplier_id"),
        text.order_address(F.lit(""), F.col("supplier_id")).alias("email"))
    return named.unionByName(unnamed)


@query("json_extract", r"""
    SELECT event_id, cast(json_extract_string(props, '$.k') AS integer) AS k,
           CASE WHEN event_type = 'error' THEN NULL ELSE 'line one' || chr(10) || event_type END
             AS note
    FROM events WHERE event_type <> 'view'
    UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_type = 'view'""")
def json_extract(t: Tables):
    events = t.spark.read.parquet(f"{t.folder}/events.parquet")
    kind = F.col("event_type")
    note = F.when(kind == "error", F.lit("")).otherwise(
        F.concat(F.lit(', "note": "line one\n'), kind, F.lit('"')))
    body = F.concat(F.regexp_replace("props", r"\}\s*$", ""), note, F.lit("}"))
    answer = F.when(kind == "view", F.lit("no object here")).otherwise(
        F.concat(F.lit("Sure, here you go:\n```json\n"), body, F.lit("\n```\nBye.")))
    read = text.json_extract(answer, "k INT, note STRING")
    return events.select("event_id", read.alias("r")).select("event_id", "r.k", "r.note")


@query("json_fields", """
    SELECT email_id, R(json_extract_string(extracted_json, '$.unit_price_usd')) AS unit_price_usd,
           R(json_extract_string(extracted_json, '$.pack_size_g')) AS pack_size_g,
           cast(json_extract_string(extracted_json, '$.lead_time_days') AS integer)
             AS lead_time_days
    FROM email_inbox""")
def json_fields(t: Tables):
    return t.email_inbox.select(
        "email_id", text.quote_fields(F.col("extracted_json")).alias("q")
    ).select("email_id", "q.*")


@query("truncate_notes", """
    SELECT email_id, substr(body_md, 1, 180) AS notes,
           upper(coalesce(nullif(lower(intent_detected), 'oof'), 'screening')) AS verdict,
           R(coalesce(nullif(supplier_id % 3, 0), 0.5)) AS score FROM email_inbox""")
def truncate_notes(t: Tables):
    verdict = F.nullif(F.lower("intent_detected"), F.lit("oof"))
    return t.email_inbox.select(
        "email_id", text.short_notes(F.col("body_md")).alias("notes"),
        text.default_verdict(verdict).alias("verdict"),
        text.default_score((F.col("supplier_id") % 3).cast("double")).alias("score"))


@query("append_reason", """
    SELECT po_id, coalesce(CASE WHEN status <> 'DRAFT' THEN rationale END, '')
                  || ' | BUDGET_EXCEEDED' AS rationale FROM po_drafts""")
def append_reason(t: Tables):
    kept = F.when(F.col("status") != "DRAFT", F.col("rationale"))
    return t.po_drafts.select("po_id", text.append_reason(kept).alias("rationale"))


@query("render_prompt", """
    SELECT event_id, 'To ' || supplier_id || ': please offer ' || printf('%.0f', pack_size_g * min_qty)
           || ' g of item ' || sku || ' as ' || min_qty || ' packs of ' || printf('%.0f', pack_size_g)
           || ' g.' || chr(10) || 'Our board shows $' || printf('%.2f', unit_price_usd)
           || ' a pack, delivered within ' || lead_time_days || ' days.' AS prompt
    FROM supplier_quotes""")
def render_prompt(t: Tables):
    c = F.col
    return t.supplier_quotes.select("event_id", text.rfq_prompt(
        c("sku"), c("pack_size_g") * c("min_qty"), c("min_qty"), c("pack_size_g"),
        c("unit_price_usd"), c("lead_time_days"), c("supplier_id")).alias("prompt"))


@query("render_application", """
    SELECT application_id, supplier_name || ' from ' || country || ' applies as a supplier of: '
           || offered_skus || '.' || chr(10) || 'Organic certificate: ' || organic_cert
           || '; trading for ' || years_in_biz || ' years; write to ' || contact_email || '.' AS prompt
    FROM supplier_applications""")
def render_application(t: Tables):
    return t.supplier_applications.select("application_id", text.application_prompt(
        *[F.col(n) for n in ("supplier_name", "country", "contact_email", "offered_skus",
                             "organic_cert", "years_in_biz")]).alias("prompt"))


@query("enum_upper", "SELECT event_id, upper(room_id) AS room_code FROM inventory_events")
def enum_upper(t: Tables):
    return t.inventory_events.select("event_id",
                                     text.upper_code(F.col("room_id")).alias("room_code"))


@query("rename_project", """
    SELECT sku, room_id, on_hand_g, event_ts AS last_event_ts FROM inventory_events""")
def rename_project(t: Tables):
    return t.inventory_events.withColumnRenamed("event_ts", "last_event_ts").drop(
        "event_id", "reason")


@query("gauge_fraction", """
    SELECT room_id, sensor_type,
           R(least(greatest((value - coalesce(disp_min, 0))
                            / (coalesce(disp_max, 100) - coalesce(disp_min, 0)), 0), 1)) AS share
    FROM gd_iot_latest""")
def gauge_fraction(t: Tables):
    share = numbers.gauge_fraction(F.col("value"), F.col("disp_min"), F.col("disp_max"))
    return views.sensors(t).select("room_id", "sensor_type", share.alias("share"))


@query("round_money", """
    SELECT po_id, round(total_cost_usd / 3, 2) AS cents, round(total_cost_usd / 3, 3) AS mills
    FROM po_drafts""")
def round_money(t: Tables):
    third = F.col("total_cost_usd") / 3
    return t.po_drafts.select("po_id", numbers.round_money(third).alias("cents"),
                              numbers.round_money(third, 3).alias("mills"))


@query("coalesce_truthy", """
    SELECT application_id, coalesce(nullif(offered_skus, ''), country) AS shown
    FROM supplier_applications""")
def coalesce_truthy(t: Tables):
    return t.supplier_applications.select("application_id", text.truthy(
        F.col("offered_skus"), F.col("country")).alias("shown"))


@query("stable_id", f"""
    SELECT po_id, {sql_id('PO', 'po_id', 'thread_id')} AS id
    FROM po_drafts""")
def stable_id(t: Tables):
    return t.po_drafts.select("po_id", text.stable_id(
        "PO", F.col("po_id"), F.col("thread_id")).alias("id"))
