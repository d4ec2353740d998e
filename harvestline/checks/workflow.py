"""Workflow steps over whole state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestline.checks import gold as views
from harvestline.checks.registry import VIEWS, Tables, query, sql_id
from harvestline.functions import timing
from harvestline.operators import aggregates
from harvestline.plans import workflow
from harvestline.plans.steps import StepLog
from harvestline.session import scratch_path
from harvestline.sources.bindings import AS_OF_EVENTS, AS_OF_MAIL, PERIOD_BUDGET_USD

VIEWS["rfq_todo"] = """
    SELECT * FROM gd_recommendations r
    WHERE decision = 'BUY_NOW' AND recommended_supplier_id IS NOT NULL AND NOT EXISTS (
      SELECT 1 FROM email_outbox o
      WHERE o.sku = r.sku AND o.supplier_id = r.recommended_supplier_id AND o.intent = 'RFQ'
        AND o.created_ts > timestamp '2023-12-31 00:10:00')"""


@query("rfq_candidates", """
    SELECT recommendation_id, sku, recommended_supplier_id, packs,
           R(total_cost_usd) AS total_cost_usd FROM rfq_todo""")
def rfq_candidates(t: Tables):
    return workflow.rfq_candidates(views.recommended(t), t.email_outbox, AS_OF_MAIL).select(
        "recommendation_id", "sku", "recommended_supplier_id", "packs", "total_cost_usd")


@query("rfq_outbox_rows", f"""
    SELECT {sql_id('EM', 'recommendation_id')} AS email_id,
           {sql_id('THR', 'recommendation_id')} AS thread_id,
           timestamp '2024-01-01 00:10:00' AS created_ts, recommended_supplier_id AS supplier_id,
           'orders@' || split_part(lower(coalesce(recommended_supplier_name,
                                   cast(recommended_supplier_id AS varchar))), ' ', 1)
             || '.demo' AS supplier_email,
           'RFQ — seed order' AS subject,
           'To ' || recommended_supplier_name || ': please offer ' || printf('%.0f', reorder_grams)
             || ' g of item ' || sku || ' as ' || packs || ' packs of ' || printf('%.0f', pack_size_g)
             || ' g.' || chr(10) || 'Our board shows $' || printf('%.2f', unit_price_usd)
             || ' a pack, delivered within ' || expected_lead_days || ' days.' AS body_md,
           sku, 'RFQ' AS intent, 'negotiator' AS sent_by, 'SENT' AS status
    FROM rfq_todo""")
def rfq_outbox_rows(t: Tables):
    todo = workflow.rfq_candidates(views.recommended(t), t.email_outbox, AS_OF_MAIL)
    return workflow.rfq_outbox_rows(todo, AS_OF_MAIL)


@query("inbound_extract", r"""
    SELECT email_id, CASE WHEN processed THEN NULL WHEN body_md LIKE 'Counter%' THEN 'COUNTER'
                          WHEN body_md LIKE 'We accept%' THEN 'ACCEPT' ELSE 'QUOTE' END
                     AS intent_detected,
           CASE WHEN NOT processed THEN R(cast(replace(
             regexp_extract(body_md, '\$([0-9.,]+) per', 1), ',', '') AS double)) END AS unit_price_usd,
           CASE WHEN NOT processed THEN R(cast(regexp_extract(body_md, 'pack of ([0-9]+) g', 1) AS double)) END
             AS pack_size_g,
           CASE WHEN NOT processed THEN try_cast(regexp_extract(body_md, 'lead time ([0-9]+) days', 1)
             AS integer) END AS lead_time_days,
           CASE WHEN NOT processed AND contains(body_md, 'organic') THEN true END AS organic,
           CASE WHEN NOT processed THEN substr(body_md, 1, 120) END AS notes, true AS processed
    FROM quote_replies""")
def inbound_extract(t: Tables):
    """Every seventh order's mail is done already; prices carry separators; some lead times
    are no numbers of days."""
    inbox = workflow.inbound_extract(t.quote_replies)
    terms = F.from_json("extracted_json", "unit_price_usd DOUBLE, pack_size_g DOUBLE, "
                                          "lead_time_days INT, organic BOOLEAN, notes STRING")
    # a generator reads the text once; plain field access would parse it per field
    return inbox.select("email_id", "intent_detected", "processed", F.inline(F.array(terms)))


VIEWS["po_todo"] = """
    SELECT l.*, o.sku AS out_sku, o.supplier_id AS out_supplier, o.email_id AS rfq_email_id
    FROM (SELECT DISTINCT ON (thread_id) * FROM email_inbox
          WHERE intent_detected IN ('QUOTE', 'ACCEPT', 'COUNTER')
          ORDER BY thread_id, received_ts DESC, email_id DESC) l
    JOIN email_outbox o ON o.thread_id = l.thread_id AND o.intent = 'RFQ'
    WHERE NOT EXISTS (SELECT 1 FROM po_drafts p WHERE p.thread_id = l.thread_id)"""


def _po_candidates(t: Tables):
    return workflow.po_candidates(t.email_inbox, t.email_outbox, t.po_drafts)


@query("po_candidates", """
    SELECT thread_id, email_id, rfq_email_id, out_sku, out_supplier, intent_detected
    FROM po_todo""")
def po_candidates(t: Tables):
    return _po_candidates(t).select("thread_id", "email_id", "rfq_email_id", "out_sku",
                                    "out_supplier", "intent_detected")


VIEWS["po_terms"] = """
    SELECT c.*, cast(json_extract_string(extracted_json, '$.unit_price_usd') AS double) AS price,
           cast(json_extract_string(extracted_json, '$.pack_size_g') AS double) AS pack,
           coalesce(nullif(cast(json_extract_string(extracted_json, '$.lead_time_days')
                                AS integer), 0), 7) AS lead,
           trunc(coalesce(r.reorder_grams, 0)
                 / nullif(cast(json_extract_string(extracted_json, '$.pack_size_g') AS double), 0)
                ) AS whole,
           r.packs AS rec_packs
    FROM po_todo c LEFT JOIN (
      SELECT * FROM gd_recommendations QUALIFY row_number() OVER (
        PARTITION BY sku ORDER BY created_ts DESC, recommendation_id DESC) = 1) r
      ON r.sku = c.sku"""


@query("po_drafts", f"""
    SELECT {sql_id('PO', 'thread_id', 'email_id', 'rfq_email_id')} AS po_id,
           timestamp '2024-01-31 00:00:00' AS created_ts, thread_id, sku,
           out_supplier AS supplier_id, cast(n AS integer) AS packs, pack AS pack_size_g,
           R(n * pack) AS total_grams, price AS unit_price_usd, R(n * price) AS total_cost_usd,
           date '2024-01-31' + lead AS needed_by, 'DRAFT' AS status,
           'Extracted from supplier email ' || email_id || '; intent=' || intent_detected
             AS rationale
    FROM (SELECT *, greatest(coalesce(nullif(whole, 0), nullif(rec_packs, 0), 10), 1) AS n
          FROM po_terms) WHERE pack <> 0 AND price <> 0""")
def po_drafts(t: Tables):
    # replies and requests carry numeric keys here; the sku fallback compares text
    candidates = _po_candidates(t).withColumns({
        c: F.col(c).cast("string") for c in ("sku", "out_sku", "supplier_id", "out_supplier")})
    recommended = views.recommended(t).withColumn("sku", F.col("sku").cast("string"))
    drafts = workflow.po_drafts(candidates, recommended, AS_OF_EVENTS)
    return drafts.withColumns({
        "sku": F.col("sku").cast("bigint"), "supplier_id": F.col("supplier_id").cast("bigint")})


@query("budget_allocation", f"""
    SELECT {sql_id('LED', 'period_ym', "'SEED'")} AS ledger_id,
           period_ym, 'SEED' AS category, cast(25000 AS double) AS balance_usd,
           'Monthly seed budget allocation ' || period_ym AS note
    FROM (SELECT DISTINCT strftime(created_ts + INTERVAL 5 YEAR, '%Y-%m') AS period_ym
          FROM po_drafts) p
    WHERE NOT EXISTS (SELECT 1 FROM budget_ledger l
                      WHERE l.period_ym = p.period_ym AND l.category = 'SEED')""")
def budget_allocation(t: Tables):
    later = F.col("created_ts") + F.expr("make_ym_interval(5)")
    periods = t.po_drafts.select(timing.period_ym(later).alias("period_ym"))
    return workflow.budget_allocation(periods, t.budget_ledger, AS_OF_EVENTS).select(
        "ledger_id", "period_ym", "category", "balance_usd", "note")


VIEWS["gate_drafts"] = """
    SELECT po_id, sku, strftime(created_ts, '%Y-%m') AS period,
           coalesce(total_cost_usd, 0) AS cost,
           row_number() OVER (PARTITION BY strftime(created_ts, '%Y-%m')
                              ORDER BY created_ts, po_id) AS n
    FROM po_drafts WHERE status = 'DRAFT'"""
VIEWS["gate_open"] = """
    SELECT p.period, coalesce(b.balance_usd, cast(2000000 AS double)) AS balance
    FROM (SELECT DISTINCT period FROM gate_drafts) p LEFT JOIN (
      SELECT period_ym, balance_usd FROM budget_ledger WHERE category = 'SEED'
      QUALIFY row_number() OVER (PARTITION BY period_ym
                                 ORDER BY entry_ts DESC, ledger_id DESC) = 1) b
      ON b.period_ym = p.period"""
VIEWS["gate_walk"] = """
    SELECT d.n, d.period, d.po_id, d.sku, d.cost, d.cost <= o.balance AS approved,
           CASE WHEN d.cost <= o.balance THEN o.balance - d.cost ELSE o.balance END AS left_after
    FROM gate_drafts d JOIN gate_open o USING (period) WHERE d.n = 1
    UNION ALL
    SELECT d.n, d.period, d.po_id, d.sku, d.cost, d.cost <= w.left_after,
           CASE WHEN d.cost <= w.left_after THEN w.left_after - d.cost ELSE w.left_after END
    FROM gate_walk w JOIN gate_drafts d ON d.period = w.period AND d.n = w.n + 1"""


def _gate(t: Tables):
    drafts = t.po_drafts.withColumn("period", timing.period_ym(F.col("created_ts")))
    return workflow.budget_gate(drafts, t.budget_ledger, AS_OF_EVENTS, period_column="period",
                                amount=PERIOD_BUDGET_USD)


@query("budget_gate", """
    SELECT p.po_id, CASE WHEN w.approved THEN 'APPROVED' WHEN NOT w.approved THEN 'REJECTED'
                    ELSE p.status END AS status,
           CASE WHEN NOT w.approved THEN coalesce(p.rationale, '') || ' | BUDGET_EXCEEDED'
                ELSE p.rationale END AS rationale
    FROM po_drafts p LEFT JOIN gate_walk w USING (po_id)""")
def budget_gate(t: Tables):
    return _gate(t).drafts.select("po_id", "status", "rationale")


@query("budget_gate_ledger", f"""
    SELECT {sql_id('LED', 'po_id')} AS ledger_id,
           period AS period_ym, 'SEED' AS category, R(-cost) AS delta_usd,
           R(left_after) AS balance_usd, po_id,
           'Approved PO ' || po_id || ' for SKU ' || sku AS note
    FROM gate_walk WHERE approved
    UNION ALL
    SELECT {sql_id('LED', 'period', "'SEED'")}, period, 'SEED',
           cast(2000000 AS double), cast(2000000 AS double), NULL,
           'Monthly seed budget allocation ' || period
    FROM gate_open WHERE period NOT IN (
      SELECT period_ym FROM budget_ledger WHERE category = 'SEED')""", round_to=2)
def budget_gate_ledger(t: Tables):
    return _gate(t).ledger_rows.drop("entry_ts")


@query("reconcile", """
    SELECT reconciliation_id, po_id, R(variance) AS variance_usd, R(pct) AS variance_pct,
           CASE WHEN expected IS NULL OR expected = 0 THEN 'DISPUTE' WHEN pct <= 1 THEN 'OK'
                WHEN pct <= 5 THEN 'REVIEW' ELSE 'DISPUTE' END AS status,
           CASE WHEN expected IS NULL OR expected = 0 THEN 'No matching PO total found'
                WHEN pct <= 1 THEN 'Within 1% tolerance'
                WHEN pct <= 5 THEN printf('%.2f', pct)
                                   || '% variance — human review recommended'
                ELSE printf('%.2f', pct) || '% variance — exceeds tolerance' END AS agent_notes
    FROM judged_invoices WHERE status = 'NEW'""")
def reconcile(t: Tables):
    return workflow.reconcile(t.invoice_reconciliations, t.po_drafts).select(
        "reconciliation_id", "po_id", "variance_usd", "variance_pct", "status", "agent_notes")


VIEWS["onboarded"] = """
    SELECT application_id, round(
             0.40 * CASE supplier_pick WHEN 0 THEN 0 WHEN 2 THEN 0.5 WHEN 4 THEN 0.5 ELSE 1 END
             + CASE WHEN organic_cert THEN 0.25 ELSE 0 END
             + 0.20 * least(years_in_biz / 5, 1)
             + 0.15 * CASE WHEN country IN (SELECT n_name FROM nation WHERE n_regionkey IN (1, 3))
                           THEN 1 ELSE 0.5 END, 6) AS score, supplier_name
    FROM (SELECT *, application_id % 5 AS supplier_pick FROM supplier_applications)"""


@query("onboard_score", """
    SELECT application_id, R(score) AS score, status,
           supplier_name || ': ' || lower(status) || ' at ' || printf('%.3f', score)
             AS agent_notes
    FROM (SELECT *, CASE WHEN score >= 0.75 THEN 'APPROVED' WHEN score >= 0.5 THEN 'SCREENING'
                    ELSE 'REJECTED' END AS status FROM onboarded)""")
def onboard_score(t: Tables):
    near = F.col("region").isin(1, 3)
    return workflow.onboard_score(t.supplier_applications, near=near).select(
        "application_id", "score", "status", "agent_notes")


def _forms(t: Tables):
    """Applications as submitted: some forms lack their country or their years."""
    return t.supplier_applications.select(
        "supplier_name", "contact_email",
        F.when(F.col("application_id") % 7 != 0, F.col("country")).alias("country"),
        "offered_skus", "organic_cert",
        F.when(F.col("years_in_biz") > 2, F.col("years_in_biz")).alias("years_in_biz"))


@query("submit_application", f"""
    SELECT {sql_id('APP', 'supplier_name', 'contact_email', 'country', "'2024-01-31T00:00:00'")}
             AS application_id,
           timestamp '2024-01-31 00:00:00' AS submitted_ts, supplier_name, contact_email, country,
           offered_skus, organic_cert,
           CASE WHEN years_in_biz > 2 THEN years_in_biz ELSE 0 END AS years_in_biz,
           'NEW' AS status, cast(NULL AS double) AS score, cast(NULL AS varchar) AS agent_notes
    FROM supplier_applications WHERE application_id % 7 <> 0""")
def submit_application(t: Tables):
    return workflow.submit_application(_forms(t), AS_OF_EVENTS)


@query("rejected_applications", """
    SELECT supplier_name, 'has_country' AS broken_rules FROM supplier_applications
    WHERE application_id % 7 = 0""")
def rejected_applications(t: Tables):
    return workflow.rejected_applications(_forms(t)).select(
        "supplier_name", F.array_join("broken_rules", ",").alias("broken_rules"))


@query("invoice_candidates", """
    SELECT po_id, supplier_id, total_cost_usd, created_ts FROM po_drafts p
    WHERE status = 'APPROVED' AND NOT EXISTS (
      SELECT 1 FROM invoice_reconciliations r WHERE r.po_id = p.po_id)""")
def invoice_candidates(t: Tables):
    return workflow.invoice_candidates(t.po_drafts, t.invoice_reconciliations)


def cycle_tables(t: Tables) -> dict:
    """The state tables of one cycle; their keys are text, as the steps make them."""
    text_keys = ("sku", "thread_id", "supplier_id", "po_id", "recommended_supplier_id",
                 "email_id", "ledger_id", "reconciliation_id", "application_id",
                 "out_sku", "out_supplier")
    invoices = t.invoice_reconciliations.withColumns({
        "expected_amount_usd": F.lit(None).cast("double"),
        "variance_usd": F.lit(None).cast("double"),
        "variance_pct": F.lit(None).cast("double"),
        "agent_notes": F.lit(None).cast("string")})
    tables = {
        "recommendations": views.recommended(t), "email_outbox": t.email_outbox,
        "email_inbox": t.email_inbox, "po_drafts": t.po_drafts,
        "budget_ledger": t.budget_ledger, "invoice_reconciliations": invoices,
        "supplier_applications": t.supplier_applications.drop("region"),
    }
    return {n: df.withColumns({c: F.col(c).cast("string") for c in df.columns if c in text_keys})
            for n, df in tables.items()}


def _cycle_counts(after: dict):
    """Rows per table and status after a cycle."""
    counts = aggregates.row_counts(after)
    for n in ("po_drafts", "invoice_reconciliations", "supplier_applications"):
        counts = counts.unionByName(after[n].groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(
            F.concat_ws(":", F.lit(n), F.col("status")).alias("table_name"), "n"))
    return counts


@query("p2p_cycle")
def p2p_cycle(t: Tables):
    return _cycle_counts(workflow.p2p_cycle(cycle_tables(t), AS_OF_EVENTS))


@query("p2p_cycle_resumed")
def p2p_cycle_resumed(t: Tables):
    """The second run of a cycle whose steps are all committed: it reads what the first one made."""
    log = StepLog(t.spark, scratch_path(t.spark, "cycles"), "seed")
    workflow.p2p_cycle(cycle_tables(t), AS_OF_EVENTS, steps=log)
    return _cycle_counts(workflow.p2p_cycle(cycle_tables(t), AS_OF_EVENTS, steps=log))
