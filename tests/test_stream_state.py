"""Versioned tables, joined order views and keyed approvals against their batch forms."""

import random
from datetime import datetime, timedelta

import pytest

from harvestline.plans import gold
from harvestline.session import scratch_path
from harvestline.streaming import approvals, feeds, joined, versions
from tests.test_budget import by_hand
from tests.test_streaming import drop_file, rows_of, stream

T0 = datetime(2024, 1, 1)


# compaction

def test_compaction_changes_no_row_and_bounds_files(spark):
    path, want = scratch_path(spark, "versions"), {}
    table = versions.VersionedTable(spark, path, versions.last_version(["k"]), every=3)
    assert table.read() is None
    rng = random.Random(1)
    for batch in range(14):
        rows = [(k, batch * 100 + k) for k in rng.sample(range(8), 3)]
        want.update(rows)
        table.write(spark.createDataFrame(rows, "k long, v long").coalesce(1), batch)
        assert {r.k: r.v for r in table.read().collect()} == want
        assert len(table.deltas()) <= 2 * 3 + 1 and len(table._names("_base")) <= 2
    before = table.read().collect()
    table.compact(13)
    assert sorted(table.read().collect()) == sorted(before)
    table.compact(13)   # nothing new to fold
    assert sorted(table.read().collect()) == sorted(before) and table.base() == 13


def test_readers_keep_their_generation_and_half_a_base_is_not_seen(spark):
    path = scratch_path(spark, "versions")
    table = versions.VersionedTable(spark, path, versions.added_up(["k"], "v"), every=100)
    for batch in range(4):
        table.write(spark.createDataFrame([(1, 10 ** batch)], "k long, v long"), batch)
    held = table.read()
    table.compact(2)
    assert [r.v for r in held.collect()] == [1111] and [r.v for r in table.read().collect()] == [1111]
    # a base without its pointer (a crash before the switch) is not read
    spark.createDataFrame([(1, 999, 3)], "k long, v long, batch_id long").write.parquet(f"{path}/_base/upto=3")
    assert [r.v for r in table.read().collect()] == [1111]
    # a batch that is replayed overwrites its delta
    table.write(spark.createDataFrame([(1, 5)], "k long, v long"), 3)
    assert [r.v for r in table.read().collect()] == [116]
    assert [r.v for r in table.read(before=3).collect()] == [111]


# order views over three feeds

ORDERS = ("event_id string, event_ts timestamp, po_number long, po_item long, event_type string, supplier_id long, sku long, "
          "quantity_g double, unit_price_usd double, net_value_usd double, delivery_date_ts timestamp")
RECEIPTS = "event_id string, event_ts timestamp, po_number long, po_item long, sku long, qty_received_g double, movement_type string"
INVOICES = ("event_id string, event_ts timestamp, invoice_doc_number string, po_number long, po_item long, supplier_id long, "
            "net_amount_usd double, variance_usd double, status string")


def order_rows(seed, n):
    rng = random.Random(seed)

    def at():
        return T0 + timedelta(minutes=rng.randrange(10_000))
    lines = [(p, i) for p in range(5) for i in range(2)]
    orders, receipts, invoices = [], [], []
    for k in range(n):
        p, i = rng.choice(lines)
        orders.append((f"o{seed}-{k}", at(), p, i, rng.choice(["CREATED", "APPROVED", "CANCELLED"]), rng.randrange(4), 1,
                       float(rng.randrange(1, 50)), 2.0, float(rng.randrange(10, 90)), at()))
        p, i = rng.choice([*lines, (9, 9)])
        receipts.append((f"r{seed}-{k}", at(), p, i, 1, float(rng.choice([5, 10, -5])), "101"))
        p, i = rng.choice([*lines, (8, 8)])
        invoices.append((f"i{seed}-{k}", at(), f"d{rng.randrange(6)}", p, i, 1, 5.0, float(rng.randrange(-3, 3)), "POSTED"))
    return {"orders": orders, "receipts": receipts, "invoices": invoices}


SCHEMAS = {"orders": ORDERS, "receipts": RECEIPTS, "invoices": INVOICES}


def test_order_views_follow_three_feeds(spark):
    """Feeds arrive interleaved, some batches hold one feed only; after each the views equal the batch."""
    suppliers = spark.createDataFrame([(k, f"n{k}", "t") for k in range(3)], "supplier_id long, supplier_name string, tier string")
    folders = {f: scratch_path(spark, f) for f in SCHEMAS}
    out = scratch_path(spark, "joined")
    all_rows = {f: [] for f in SCHEMAS}
    streams = {f: stream(spark, folders[f], SCHEMAS[f]) for f in SCHEMAS}
    views = joined.OrderViews(spark, out, 2)
    deliveries = [("orders", "receipts"), ("invoices",), ("receipts",), ("orders",), ("orders", "receipts", "invoices")]
    for step, names in enumerate(deliveries):
        rows = order_rows(step, 6)
        for f in names:
            all_rows[f] += rows[f]
            drop_file(spark, rows[f], SCHEMAS[f], folders[f])
        joined.stream_order_views(**streams, suppliers=suppliers, path=out, checkpoint=f"{out}-cp", compact_every=2).awaitTermination()
        batch = {f: spark.createDataFrame(all_rows[f], SCHEMAS[f]) for f in SCHEMAS}
        want = gold.open_po_lines(batch["orders"], batch["receipts"], suppliers)
        columns = ["po_number", "po_item", "event_id", "po_status", "qty_received_g", "supplier_name"]
        assert rows_of(views.lines.read(), *columns) == rows_of(want, *columns)
        want = gold.invoice_matching(batch["invoices"], batch["orders"], batch["receipts"])
        columns = ["invoice_doc_number", "event_id", "match_status", "gr_qty_g", "po_net_value_usd"]
        assert rows_of(views.matches.read(), *columns) == rows_of(want, *columns)
    # only touched keys were written
    last = spark.read.parquet(f"{out}/po_lines/batch_id={views.lines.deltas()[-1]}")
    touched = {(r[2], r[3]) for f in ("orders", "receipts") for r in order_rows(4, 6)[f]}
    assert {(r.po_number, r.po_item) for r in last.collect()} <= touched


# approvals as keyed state

DRAFTS = "po_id string, created_ts timestamp, total_cost_usd double"
BEAT = ("beat", T0 + timedelta(days=4000), None)


def decided(spark, deliveries, lateness, amount=3000.0):
    folder, out = scratch_path(spark, "drafts"), scratch_path(spark, "approvals")
    for rows in deliveries:
        drop_file(spark, rows, DRAFTS, folder)
        found = approvals.stream_approvals(stream(spark, folder, DRAFTS, 100), lateness=lateness, amount=amount)
        feeds.append_to(found, out, f"{out}-cp").awaitTermination()   # each delivery restarts the query
    return {r.po_id: (r.approved, r.balance_after) for r in spark.read.parquet(out).collect() if r.po_id != "beat"}


@pytest.mark.parametrize("seed", [1, 2])
def test_approvals_equal_the_batch_for_any_split(spark, seed):
    rng = random.Random(seed)
    rows = [(f"P{i:03d}", T0 + timedelta(hours=rng.randrange(2400)), rng.choice([None, round(rng.uniform(1, 400), 2)]))
            for i in range(150)]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, 149), 2))
    parts = [rows[:cuts[0]], rows[cuts[0]:cuts[1]], rows[cuts[1]:], [BEAT]]
    named = [(p, ts.strftime("%Y-%m"), ts, c) for p, ts, c in rows]
    assert decided(spark, parts, "200 days") == by_hand(named, {r[1]: 3000.0 for r in named})


def test_drafts_wait_for_the_watermark_and_closed_periods_reject(spark):
    def at(days):
        return T0 + timedelta(days=days)
    first = [("b", at(2), 60.0), ("a", at(1), 60.0)]
    assert decided(spark, [first], "5 days", 100.0) == {}
    got = decided(spark, [first, [("c", at(70), 10.0)], [("late", at(3), 1.0)], [BEAT]], "5 days", 100.0)
    assert got["a"] == (True, 40.0) and got["b"] == (False, None) and got["c"] == (True, 90.0)
    assert got.get("late", (False, None)) == (False, None)


def test_order_views_count_copies_once_without_stream_state(spark):
    """Events delivered again in a later batch change nothing; no operator of the stream keeps state."""
    suppliers = spark.createDataFrame([(0, "n", "t")], "supplier_id long, supplier_name string, tier string")
    folders = {f: scratch_path(spark, f) for f in SCHEMAS}
    out, rows = scratch_path(spark, "joined"), order_rows(1, 6)
    streams = {f: stream(spark, folders[f], SCHEMAS[f]) for f in SCHEMAS}
    for names in (tuple(SCHEMAS), ("receipts",)):
        for f in names:
            drop_file(spark, rows[f], SCHEMAS[f], folders[f])
        query = joined.stream_order_views(**streams, suppliers=suppliers, path=out, checkpoint=f"{out}-cp")
        query.awaitTermination()
        assert not any(p.stateOperators for p in query.recentProgress)
    batch = {f: spark.createDataFrame(rows[f], SCHEMAS[f]) for f in SCHEMAS}
    columns = ["po_number", "po_item", "event_id", "po_status", "qty_received_g"]
    want = gold.open_po_lines(batch["orders"], batch["receipts"], suppliers)
    assert rows_of(joined.OrderViews(spark, out).lines.read(), *columns) == rows_of(want, *columns)
