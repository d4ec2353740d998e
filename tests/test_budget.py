"""First-fit approval against a row-by-row walk, on every path."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harvestline.operators import budget
from harvestline.plans import workflow

SCHEMA = "po_id string, period string, created_ts timestamp_ntz, total_cost_usd double"


def by_hand(rows, balances):
    left = {p: round(b * 1e6) for p, b in balances.items()}
    out = {}
    for po, period, _, cost in sorted(rows, key=lambda r: (r[2], r[0])):
        c = round((cost or 0.0) * 1e6)
        ok = c <= left.get(period, 0)
        if ok:
            left[period] = left.get(period, 0) - c
        out[po] = (ok, left[period] / 1e6 if ok else None)
    return out


def allocate(spark, rows, balances, limit):
    requests = spark.createDataFrame(rows, SCHEMA).repartition(5)
    budgets = spark.createDataFrame(list(balances.items()), "period string, balance_usd double")
    got = budget.greedy_allocate(requests, budgets, ["period"], ["created_ts", "po_id"],
                                 "total_cost_usd", walk_limit=limit)
    assert got.count() == len(rows)
    return {r.po_id: (r.approved, r.balance_after) for r in got.collect()}


def random_rows(seed, n, low, high, hot_share=0.5, nulls=0.05):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        period = "hot" if rng.random() < hot_share else f"p{rng.randrange(4)}"
        cost = None if rng.random() < nulls else round(rng.uniform(low, high), 2)
        rows.append((f"PO{i:05d}", period, start + timedelta(hours=rng.randrange(n // 3)), cost))
    return rows


BALANCES = {"hot": 5000.0, "p0": 900.0, "p1": 20.0, "p2": 100000.0}


@pytest.mark.parametrize("limit", [1_000_000, 40, 7])
@pytest.mark.parametrize(("low", "high"), [(1, 400), (0, 30)])
def test_matches_walk(spark, limit, low, high):
    rows = random_rows(11, 300, low, high)
    assert allocate(spark, rows, BALANCES, limit) == by_hand(rows, BALANCES)


@pytest.mark.parametrize("limit", [1_000_000, 40])
def test_credits_raise_the_balance_again(spark, limit):
    rows = random_rows(5, 200, -100, 300)
    assert allocate(spark, rows, BALANCES, limit) == by_hand(rows, BALANCES)


def test_adversarial_alternation(spark):
    """Small and just-too-large costs in turn: every prefix round gains one row."""
    start = datetime(2024, 1, 1)
    rows = [(f"PO{i:04d}", "hot", start + timedelta(minutes=i),
             1.0 if i % 2 == 0 else 100.0 - i // 2) for i in range(80)]
    assert allocate(spark, rows, {"hot": 100.0}, 10) == by_hand(rows, {"hot": 100.0})


def test_edges(spark):
    t = datetime(2024, 1, 1)
    rows = [("A", "m", t, 100.0), ("B", "m", t + timedelta(1), 0.01), ("C", "m", t, None),
            ("D", "n", t, 101.0), ("E", "n", t + timedelta(1), 60.0),
            ("F", "n", t + timedelta(2), 40.0), ("G", "none", t, 1.0)]
    got = allocate(spark, rows, {"m": 100.0, "n": 100.0}, 1000)
    assert got["A"] == (True, 0.0)          # cost equal to the balance
    assert got["B"] == (False, None)
    assert got["C"] == (True, 0.0)          # no cost counts as nothing
    assert [got[k][0] for k in "DEF"] == [False, True, True]  # too large, then smaller
    assert got["G"] == (False, None)        # no budget at all


def test_gate_allocates_and_balances(spark):
    t = datetime(2024, 3, 1)
    drafts = spark.createDataFrame(
        [("P1", t, "s", 20000.0, "DRAFT", None), ("P2", t + timedelta(1), "s", 9000.0, "DRAFT", "r"),
         ("P3", t + timedelta(2), "s", 5000.0, "DRAFT", "r"), ("P4", t, "s", 1.0, "SENT", "r")],
        "po_id string, created_ts timestamp_ntz, sku string, total_cost_usd double, "
        "status string, rationale string")
    ledger = spark.createDataFrame(
        [], "ledger_id string, entry_ts timestamp_ntz, period_ym string, category string, "
            "delta_usd double, balance_usd double, po_id string, note string")
    result = workflow.budget_gate(drafts, ledger, datetime(2024, 3, 9))
    states = {r.po_id: (r.status, r.rationale) for r in result.drafts.collect()}
    assert states == {"P1": ("APPROVED", None), "P2": ("REJECTED", "r | BUDGET_EXCEEDED"),
                      "P3": ("APPROVED", "r"), "P4": ("SENT", "r")}
    rows = result.ledger_rows.orderBy(F.col("balance_usd").desc()).collect()
    assert [(r.delta_usd, r.balance_usd) for r in rows] == [
        (25000.0, 25000.0), (-20000.0, 5000.0), (-5000.0, 0.0)]
    assert {r.period_ym for r in rows} == {"2024-03"}
    # a second run finds the allocation and the spent balance
    again = workflow.budget_gate(drafts, result.ledger_rows.where("balance_usd > 0"),
                                 datetime(2024, 3, 9))
    assert again.ledger_rows.count() == 1


def test_totals_beyond_a_long(spark):
    """Requests that add up to more than 2^63 micro-dollars: both ways agree with the walk."""
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(f"P{i:03d}", "p", start + timedelta(minutes=i), 9e10 - rng.randint(0, 9) * 1e9) for i in range(200)]
    want = by_hand(rows, {"p": 1e11})
    assert sum(round(r[3] * 1e6) for r in rows) > 2**63
    assert allocate(spark, rows, {"p": 1e11}, 10) == want
    assert allocate(spark, rows, {"p": 1e11}, 10_000) == want
