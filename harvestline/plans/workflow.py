"""Procurement workflow: each step turns whole state tables into new rows or versions.

`limit` is the batch size of a step where one is wanted; without it a step takes the
whole backlog. Ids are digests of their inputs, so a rerun repeats them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline import constants, schemas
from harvestline.functions import numbers, status, text, timing
from harvestline.operators import budget, joins, latest, quality, state
from harvestline.operators.quality import Rule
from harvestline.plans.steps import StepLog
from harvestline.session import cut_lineage



# ---- requests for quotes ----------------------------------------------------------


def rfq_candidates(recommendations: DataFrame, outbox: DataFrame, as_of: datetime,
                   limit: int | None = None) -> DataFrame:
    """Urgent recommendations with a supplier that was not asked within a day, newest first."""
    urgent = recommendations.where("decision = 'BUY_NOW' AND recommended_supplier_id IS NOT NULL")
    return latest.newest_first(joins.without_recent_rfq(urgent, outbox, as_of),
                               "created_ts", ["recommendation_id"], limit)


def rfq_outbox_rows(candidates: DataFrame, as_of: datetime) -> DataFrame:
    """Outbox rows asking for a firm quote."""
    c = {n: F.col(n) for n in candidates.columns}
    supplier, name = c["recommended_supplier_id"], c["recommended_supplier_name"]
    return candidates.select(
        text.stable_id("EM", c["recommendation_id"]).alias("email_id"),
        text.stable_id("THR", c["recommendation_id"]).alias("thread_id"),
        timing.instant(as_of, candidates.schema["created_ts"].dataType).alias("created_ts"),
        supplier.alias("supplier_id"),
        text.order_address(name, supplier).alias("supplier_email"),
        F.lit("RFQ — seed order").alias("subject"),
        text.rfq_prompt(c["sku"], c["reorder_grams"], c["packs"], c["pack_size_g"],
                        c["unit_price_usd"], c["expected_lead_days"],
                        text.truthy(name, supplier.cast("string"))).alias("body_md"),
        "sku",
        F.lit("RFQ").alias("intent"),
        F.lit("negotiator").alias("sent_by"),
        F.lit("SENT").alias("status"),
    )


# ---- replies ----------------------------------------------------------------------


def reply_terms(inbox: DataFrame) -> DataFrame:
    """Terms read from each reply's subject and body; `notes` is how the body begins."""
    reply = F.concat_ws("\n\n", "subject", "body_md")
    return inbox.withColumns({
        "intent_detected": text.reply_intent(reply),
        "unit_price_usd": text.reply_price(reply),
        "pack_size_g": text.reply_pack(reply),
        "lead_time_days": text.reply_lead_days(reply),
        "organic": text.reply_organic(reply),
        "notes": text.short_notes(F.col("body_md"), 120),
    })


def inbound_extract(inbox: DataFrame) -> DataFrame:
    """New inbox version: unprocessed mail gets intent and terms and is marked done.

    A reply without subject and body is marked done too, with no terms. Mail that is done
    passes unread.
    """
    done = inbox.where("processed")
    todo = inbox.where("NOT coalesce(processed, false)")
    read = reply_terms(todo.withColumnRenamed("intent_detected", "_old_intent"))
    terms = F.to_json(F.struct(
        "intent_detected", "unit_price_usd", "pack_size_g", "lead_time_days", "organic", "notes"))
    readable = F.col("body_md").isNotNull() | F.col("subject").isNotNull()
    return done.unionByName(read.select(*[
        {
            "intent_detected": F.when(readable, F.col("intent_detected"))
            .otherwise(F.col("_old_intent")).alias("intent_detected"),
            "extracted_json": F.when(readable, terms)
            .otherwise(F.col("extracted_json")).alias("extracted_json"),
            "processed": F.lit(True).alias("processed"),
        }.get(name, F.col(name))
        for name in inbox.columns
    ]))


# ---- order drafts -----------------------------------------------------------------


def po_candidates(inbox: DataFrame, outbox: DataFrame, drafts: DataFrame,
                  limit: int | None = None) -> DataFrame:
    """Latest usable reply per thread, with its request, where no draft exists yet.

    Intents are filtered before the latest reply is chosen.
    """
    usable = quality.status_in(inbox, "intent_detected", constants.REPLY_INTENTS_FOR_PO)
    newest = latest.latest_per_key(usable, ["thread_id"], "received_ts", ["email_id"])
    open_threads = joins.without(joins.thread_rfq_join(newest, outbox), drafts, "thread_id")
    return latest.newest_first(open_threads, "received_ts", ["email_id", "rfq_email_id"], limit)


def po_drafts(candidates: DataFrame, recommendations: DataFrame, as_of: datetime) -> DataFrame:
    """Draft rows; replies without a price or pack size give none."""
    quote = text.quote_fields(F.col("extracted_json"))
    priced = (
        candidates.withColumn("_q", quote)
        .where((F.col("_q.unit_price_usd") != 0) & (F.col("_q.pack_size_g") != 0))
        .withColumn("sku", text.truthy(F.col("sku"), F.col("out_sku")))
    )
    sized = joins.latest_recommendation(priced, recommendations).withColumn(
        "packs", numbers.packs_down(F.col("rec_grams"), F.col("_q.pack_size_g"),
                                    F.col("rec_packs")))
    stamp = timing.instant(as_of, candidates.schema["received_ts"].dataType)
    packs, price = F.col("packs"), F.col("_q.unit_price_usd")
    return sized.select(
        text.stable_id("PO", F.col("thread_id"), F.col("email_id"),
                       F.col("rfq_email_id")).alias("po_id"),
        stamp.alias("created_ts"),
        "thread_id",
        "sku",
        text.truthy(F.col("out_supplier"), F.col("supplier_id")).alias("supplier_id"),
        "packs",
        F.col("_q.pack_size_g").alias("pack_size_g"),
        (packs * F.col("_q.pack_size_g")).alias("total_grams"),
        price.alias("unit_price_usd"),
        (packs * price).alias("total_cost_usd"),
        timing.needed_by(stamp, F.col("_q.lead_time_days")).alias("needed_by"),
        F.lit("DRAFT").alias("status"),
        F.format_string("Extracted from supplier email %s; intent=%s",
                        F.col("email_id").cast("string"),
                        F.col("intent_detected")).alias("rationale"),
    )


# ---- budget -----------------------------------------------------------------------


def current_balance(ledger: DataFrame) -> DataFrame:
    """Newest balance per period and category."""
    return latest.latest_per_key(
        ledger, ["period_ym", "category"], "entry_ts", ["ledger_id"]
    ).select("period_ym", "category", "balance_usd", "entry_ts")


def budget_allocation(periods: DataFrame, ledger: DataFrame, as_of: datetime, *,
                      category: str = constants.SEED_CATEGORY,
                      amount: float = constants.MONTHLY_BUDGET_USD) -> DataFrame:
    """First ledger entry of every period in `periods` that has none in the category."""
    known = ledger.where(F.col("category") == category)
    period = F.col("period_ym")
    return joins.without(periods.select("period_ym").distinct(), known, "period_ym").select(
        text.stable_id("LED", period, F.lit(category)).alias("ledger_id"),
        timing.instant(as_of, ledger.schema["entry_ts"].dataType).alias("entry_ts"),
        "period_ym",
        F.lit(category).alias("category"),
        F.lit(float(amount)).alias("delta_usd"),
        F.lit(float(amount)).alias("balance_usd"),
        F.lit(None).cast(ledger.schema["po_id"].dataType).alias("po_id"),
        F.concat(F.lit("Monthly seed budget allocation "), period).alias("note"),
    )


class GateResult(NamedTuple):
    drafts: DataFrame
    ledger_rows: DataFrame


def budget_gate(drafts: DataFrame, ledger: DataFrame, as_of: datetime, *,
                category: str = constants.SEED_CATEGORY,
                amount: float = constants.MONTHLY_BUDGET_USD,
                period_column: str | None = None,
                walk_limit: int = budget.WALK_LIMIT) -> GateResult:
    """Approve or reject DRAFT orders, oldest first, against the balance of their period.

    The period is that of `as_of` unless `period_column` names one. Returns the new
    version of the drafts table and the ledger rows to append (allocations first).
    """
    here = (F.col(period_column) if period_column
            else F.lit(timing.resolve(as_of).strftime("%Y-%m")))
    open_drafts = drafts.where("status = 'DRAFT'").withColumn("_period", here)
    periods = open_drafts.select(F.col("_period").alias("period_ym"))
    opened = budget_allocation(periods, ledger, as_of, category=category, amount=amount)
    balances = current_balance(
        ledger.where(F.col("category") == category).unionByName(opened)
    ).select(F.col("period_ym").alias("_period"), "balance_usd")
    decided = budget.greedy_allocate(
        open_drafts.select("po_id", "created_ts", "_period", "sku", "total_cost_usd"),
        balances, ["_period"], ["created_ts", "po_id"], "total_cost_usd", walk_limit=walk_limit)
    decided = cut_lineage(decided, "budget-gate")

    verdicts = decided.select("po_id", F.col("approved").alias("_approved"))
    joined = drafts.join(verdicts, "po_id", "left")
    verdict = F.col("_approved")
    new_drafts = joined.select(*[
        {
            "status": F.when(verdict, "APPROVED").when(~verdict, "REJECTED")
            .otherwise(F.col("status")).alias("status"),
            "rationale": F.when(~verdict, text.append_reason(F.col("rationale")))
            .otherwise(F.col("rationale")).alias("rationale"),
        }.get(c, F.col(c))
        for c in drafts.columns
    ])
    spent = decided.where("approved").select(
        text.stable_id("LED", F.col("po_id")).alias("ledger_id"),
        timing.instant(as_of, ledger.schema["entry_ts"].dataType).alias("entry_ts"),
        F.col("_period").alias("period_ym"),
        F.lit(category).alias("category"),
        (-F.coalesce("total_cost_usd", F.lit(0.0))).alias("delta_usd"),
        F.col("balance_after").alias("balance_usd"),
        F.col("po_id").cast(ledger.schema["po_id"].dataType).alias("po_id"),
        F.format_string("Approved PO %s for SKU %s", F.col("po_id").cast("string"),
                        F.col("sku").cast("string")).alias("note"),
    )
    return GateResult(new_drafts, opened.unionByName(spent))


# ---- invoices ---------------------------------------------------------------------


def invoice_candidates(drafts: DataFrame, invoices: DataFrame,
                       limit: int | None = None) -> DataFrame:
    """Approved orders without an invoice, oldest first."""
    open_orders = joins.without(drafts.where("status = 'APPROVED'"), invoices, "po_id")
    return latest.oldest_batch(
        open_orders.select("po_id", "supplier_id", "total_cost_usd", "created_ts"),
        "created_ts", ["po_id"], limit)


def already_invoiced(drafts: DataFrame, invoices: DataFrame) -> DataFrame:
    """Orders that have an invoice: not to be invoiced again."""
    return joins.having(drafts, invoices, "po_id")


def reconcile(invoices: DataFrame, drafts: DataFrame, limit: int | None = None) -> DataFrame:
    """NEW invoices compared with their orders: variance, percentage, status, note."""
    fresh = invoices.where("status = 'NEW'")
    if limit is not None:
        fresh = latest.oldest_batch(fresh, "received_ts", ["reconciliation_id"], limit)
    judged = joins.invoice_vs_order(
        fresh.drop("expected_amount_usd", "variance_usd", "variance_pct", "status",
                   "agent_notes"), drafts)
    pct = F.format_string("%.2f%%", F.col("variance_pct"))
    note = (
        F.when(~numbers.has_total(F.col("expected_amount_usd")),
               F.lit("No matching PO total found"))
        .when(F.col("status") == "OK", F.lit("Within 1% tolerance"))
        .when(F.col("status") == "REVIEW",
              F.concat(pct, F.lit(" variance — human review recommended")))
        .otherwise(F.concat(pct, F.lit(" variance — exceeds tolerance")))
    )
    return judged.withColumn("agent_notes", note)


# ---- supplier onboarding ----------------------------------------------------------


def onboard_score(applications: DataFrame, *, near: Column | None = None,
                  catalogue: Sequence[str] = tuple(constants.CATALOGUE),
                  limit: int | None = None) -> DataFrame:
    """Rubric score and verdict of open applications.

    Relevance is the share of offered items found in the catalogue; years count in full
    from five; a country within reach (`near` is TRUE) counts in full, any other half.
    """
    todo = quality.status_in(applications, "status", constants.OPEN_APPLICATIONS)
    if limit is not None:
        todo = latest.oldest_batch(todo, "submitted_ts", ["application_id"], limit)
    weights = constants.ONBOARD_WEIGHTS
    offered = F.filter(
        F.transform(F.split(F.lower(F.coalesce("offered_skus", F.lit(""))), ","),
                    lambda s: F.trim(s)), lambda s: s != "")
    wanted = F.array(*[F.lit(c) for c in catalogue])
    hits = F.size(F.filter(offered, lambda s: F.array_contains(wanted, s)))
    relevance = F.coalesce(F.try_divide(hits, F.size(offered)), F.lit(0.0))
    years = F.least(F.greatest(F.coalesce("years_in_biz", F.lit(0)), F.lit(0)) / 5.0, F.lit(1.0))
    country = F.when(F.lit(False) if near is None else near, F.lit(1.0)).otherwise(F.lit(0.5))
    total = (
        weights["relevance"] * relevance
        + weights["organic"] * numbers.flag(F.col("organic_cert"))
        + weights["years"] * years
        + weights["country"] * country
    )
    scored = todo.withColumn("score", F.round(total, 6)).withColumn(
        "status", status.onboard_verdict(F.col("score")))
    note = F.concat(F.col("supplier_name"), F.lit(": "), F.lower("status"),
                    F.format_string(" at %.3f", F.col("score")))
    return scored.withColumn("agent_notes", text.short_notes(note))


APPLICATION_RULES = [
    Rule(f"has_{c}", f"{c} IS NOT NULL") for c in ("supplier_name", "contact_email", "country")
]


def submit_application(payloads: DataFrame, as_of: datetime) -> DataFrame:
    """Application rows from submitted forms: required fields checked, defaults set."""
    accepted = quality.expect_or_drop(payloads, APPLICATION_RULES)
    shape = schemas.STATE["supplier_applications"]
    return accepted.select(
        text.stable_id("APP", F.col("supplier_name"), F.col("contact_email"),
                       F.col("country"), F.lit(timing.resolve(as_of).isoformat())).alias("application_id"),
        timing.instant(as_of, shape["submitted_ts"].dataType).alias("submitted_ts"),
        "supplier_name",
        "contact_email",
        "country",
        F.coalesce("offered_skus", F.lit("")).alias("offered_skus"),
        F.coalesce("organic_cert", F.lit(False)).alias("organic_cert"),
        F.coalesce("years_in_biz", F.lit(0)).cast("int").alias("years_in_biz"),
        F.lit("NEW").alias("status"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("agent_notes"),
    )


def rejected_applications(payloads: DataFrame) -> DataFrame:
    """Submitted forms that lack required fields, with the fields they lack."""
    return quality.quarantine(payloads, APPLICATION_RULES)


# ---- one cycle --------------------------------------------------------------------


def p2p_cycle(tables: Mapping[str, DataFrame], as_of: datetime, *, near: Column | None = None,
              steps: StepLog | None = None) -> dict[str, DataFrame]:
    """All steps in order over one set of state tables; returns the new versions.

    Needs recommendations, email_outbox, email_inbox, po_drafts, budget_ledger,
    invoice_reconciliations and supplier_applications; `agent_runs`, if given, gains one
    audit row per row a step handled. What a step makes is written to shared storage once
    and added to the rows that stay, so neither is computed or written again. `near` tells
    which applications come from countries in reach; unknown counts half.

    `steps` is the log of this cycle. A cycle that was cut off and is run again over the same
    tables and `as_of` with the same log reads what its committed steps made and goes on with
    the first one that is missing. Without a log nothing outlives the call's scratch.
    """
    out = dict(tables)
    logs: list[DataFrame] = []

    def made(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return cut_lineage(build(), f"cycle-{name}") if steps is None else steps.once(name, build)

    def log(agent: str, rows: DataFrame, ref: str, result: str) -> None:
        logs.append(state.run_log(rows, agent, timing.resolve(as_of), input_ref=F.col(ref),
                                  output_ref=F.col(result)))

    asked = made("email_outbox", lambda: rfq_outbox_rows(
        rfq_candidates(tables["recommendations"], tables["email_outbox"], as_of), as_of))
    outbox = out["email_outbox"] = tables["email_outbox"].unionByName(asked)
    log("negotiator", asked, "email_id", "thread_id")

    mail = tables["email_inbox"]
    read = made("email_inbox", lambda: inbound_extract(mail.where("NOT coalesce(processed, false)")))
    inbox = out["email_inbox"] = mail.where("processed").unionByName(read)
    log("negotiator", read, "email_id", "thread_id")

    new_drafts = made("new_drafts", lambda: po_drafts(
        po_candidates(inbox, outbox, tables["po_drafts"]), tables["recommendations"], as_of))

    @cache
    def gate() -> GateResult:
        return budget_gate(tables["po_drafts"].unionByName(new_drafts), tables["budget_ledger"], as_of)

    entries = made("budget_ledger", lambda: gate().ledger_rows)
    out["budget_ledger"] = tables["budget_ledger"].unionByName(entries)
    drafts = out["po_drafts"] = made("po_drafts", lambda: gate().drafts)

    judged = made("invoice_reconciliations", lambda: reconcile(tables["invoice_reconciliations"], drafts))
    out["invoice_reconciliations"] = state.state_update(
        tables["invoice_reconciliations"], judged, "reconciliation_id",
        ["expected_amount_usd", "variance_usd", "variance_pct", "status", "agent_notes"])
    log("invoice_reconciler", judged, "reconciliation_id", "status")

    scored = made("supplier_applications", lambda: onboard_score(tables["supplier_applications"], near=near))
    out["supplier_applications"] = state.state_update(
        tables["supplier_applications"], scored, "application_id",
        ["status", "score", "agent_notes"])
    log("supplier_onboarding", scored, "application_id", "status")

    for rows in logs:
        known = out.get("agent_runs")
        out["agent_runs"] = rows if known is None else known.unionByName(rows, allowMissingColumns=True)
    return out
