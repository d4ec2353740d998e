"""Edge cases of single operators, and the split forms against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harvestline.functions import numbers, scoring, status, text, timing
from harvestline.operators import aggregates, asof, joins, latest, quality, state
from harvestline.plans import gold, silver, workflow
from harvestline.sources import readers

T0 = datetime(2024, 1, 1)


def one(spark, column, **values):
    """Value of a column expression over a single row."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


# ---- rules and duplicates ---------------------------------------------------------


@pytest.mark.parametrize("feed", sorted(silver.FEEDS))
def test_null_breaks_every_rule(spark, feed):
    rules = silver.FEEDS[feed].rules
    columns = {r.predicate.split()[0] for r in rules}
    nulls = spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in columns])
    assert quality.expect_or_drop(nulls, rules).count() == 0
    assert all(r.dropped == 1 for r in quality.rule_metrics(nulls, rules).collect())
    assert len(quality.quarantine(nulls, rules).first().broken_rules) == len(rules)


def test_zero_pack_is_dropped_before_division(spark):
    quotes = spark.createDataFrame(
        [("a", 10.0, 0.0, 1), ("b", 10.0, 4.0, 0), ("c", 0.0, 4.0, 1), ("d", 1.0, 4.0, -1)],
        "event_id string, unit_price_usd double, pack_size_g double, lead_time_days int")
    kept = silver.silver("supplier_quotes", quotes).collect()
    assert [(r.event_id, r.usd_per_gram) for r in kept] == [("b", 2.5)]


def test_copies_collapse(spark):
    rows = [("a", 1)] * 50 + [("b", 2)]
    df = spark.createDataFrame(rows, "event_id string, v int")
    assert quality.dedup_event_id(df).count() == 2
    report = quality.pk_unique(df, ["event_id"]).first()
    assert (report.total_rows, report.distinct_keys, report.is_unique) == (51, 2, False)
    with pytest.raises(ValueError, match="repeats"):
        quality.assert_unique(df, ["event_id"], "t")


def test_of_copies_that_differ_the_least_row_stays(spark):
    rows = [("a", None, 2.0), ("a", "x", 1.0), ("b", "y", 2.0), ("b", "x", 3.0), (None, "z", 1.0), (None, "z", 1.0)]
    df = spark.createDataFrame(rows, "event_id string, sku string, value double")
    for parts in (1, 5):
        got = quality.dedup_event_id(df.repartition(parts)).collect()
        assert sorted(map(tuple, got), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)
    only = df.select("event_id")
    assert quality.dedup_event_id(only).count() == 3


def test_empty_tables_audit(spark):
    df = spark.createDataFrame([], "event_id string, v int")
    assert quality.pk_unique(df, ["event_id"]).first().is_unique
    assert aggregates.count_distinct(df, "event_id").first().total == 0


def test_schema_audit_reports_missing(spark):
    found = quality.schema_audit(spark.range(3).withColumnRenamed("id", "a"), ["a", "b"])
    assert {(r.column_name, r.present, r.non_null) for r in found.collect()} == {
        ("a", True, 3), ("b", False, 0)}


def test_optional_filters_skip_missing(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "status string, n int")
    assert quality.optional_filters(df, {"status": None, "n": None}).count() == 2
    assert quality.optional_filters(df, {"status": "b"}, ["status"]).first().n == 2


# ---- latest rows and ranks --------------------------------------------------------


def test_latest_breaks_ties_by_id(spark):
    rows = [("k", T0, "e1", 1), ("k", T0, "e2", 2), ("k", T0 - timedelta(1), "e9", 3)]
    df = spark.createDataFrame(rows, "key string, event_ts timestamp_ntz, event_id string, v int")
    assert [r.v for r in latest.latest_per_key(df, ["key"]).collect()] == [2]


@pytest.mark.parametrize("scores", ["mixed", "equal", "narrow"])
@pytest.mark.parametrize("chunks", [None, 4, 50])
def test_score_rank_is_exact(spark, chunks, scores):
    rng = random.Random(3)
    draw = {"mixed": lambda: round(rng.choice([rng.random(), 0.5, 1.0, 0.0]), 2),
            "equal": lambda: 0.5, "narrow": lambda: 0.5 + rng.random() * 1e-6}[scores]
    rows = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.2 else f"s{rng.randrange(5)}", i,
             None if i % 97 == 0 else draw())
            for i in range(800)]
    df = spark.createDataFrame(rows, "sku string, supplier_id int, score double")
    got = {(r.sku, r.supplier_id): r["rank"]
           for r in latest.score_rank(df, "sku", "score", "supplier_id", chunks).collect()}
    want = {}
    for sku in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == sku),
                       key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want |= {(sku, r[1]): n for n, r in enumerate(group, 1)}
    assert got == want


def test_chunks_follow_the_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("sku"))
    assert latest.chunks_for(df, "sku") == 1
    assert latest.chunks_for(df, "sku", rows=100) == 20
    assert latest.chunks_for(df.limit(0), "sku") == 1


# ---- as-of ------------------------------------------------------------------------


def price_rows(n, seed, ties=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        step = rng.randrange(0, 60 * 24 * 5) if ties else i * 7
        rows.append((i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(3)}",
                     T0 + timedelta(minutes=step), round(rng.uniform(0, 9), 2)))
    return rows


PRICES = "event_id int, input_key string, event_ts timestamp_ntz, price_usd double"


@pytest.mark.parametrize("bucket", [timedelta(minutes=10), timedelta(hours=6), None])
@pytest.mark.parametrize("horizon", [timedelta(0), timedelta(hours=1), timedelta(hours=30)])
def test_asof_each_row_is_exact(spark, bucket, horizon):
    rows = price_rows(250, 5)
    df = spark.createDataFrame(rows, PRICES)
    got = {r.event_id: r.ref_value for r in asof.asof_each_row(
        df, "input_key", "event_ts", "price_usd", horizon, bucket=bucket).collect()}
    want = {}
    for i, key, ts, _ in rows:
        older = [r for r in rows if r[1] == key and r[2] <= ts - horizon]
        want[i] = max(older, key=lambda r: (r[2], r[0]))[3] if older else None
    assert got == want


def test_asof_each_row_null_key_and_long_series(spark, monkeypatch):
    """NULL is a key of its own; a long even series is carried through many spans."""
    monkeypatch.setattr(asof, "SPAN", 7)
    rows = [(i, None if i % 3 == 0 else "k", T0 + timedelta(minutes=17 * i), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, PRICES)
    horizon = timedelta(hours=30)
    got = {r.event_id: r.ref_value for r in asof.asof_each_row(
        df, "input_key", "event_ts", "price_usd", horizon, bucket=timedelta(minutes=20)).collect()}
    want = {}
    for i, key, ts, _ in rows:
        older = [r for r in rows if r[1] == key and r[2] <= ts - horizon]
        want[i] = max(older, key=lambda r: (r[2], r[0]))[3] if older else None
    assert got == want


def test_bucket_width_follows_the_densest_hour(spark):
    rows = [(i, "hot", T0 + timedelta(seconds=i), 1.0) for i in range(3600)]
    rows += [(9000 + i, "cold", T0 + timedelta(days=i), 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, PRICES)
    assert asof.bucket_width(df, "input_key", "event_ts", rows=60) == timedelta(minutes=1)
    assert asof.bucket_width(df, "input_key", "event_ts", rows=36000) == timedelta(hours=10)
    assert asof.bucket_width(df.limit(0), "input_key", "event_ts") == timedelta(days=365)


def test_commodity_latest_edges(spark):
    as_of = T0 + timedelta(days=2)
    rows = [(1, "young", as_of - timedelta(minutes=30), 5.0),
            (2, "zero", as_of - timedelta(hours=30), 0.0), (3, "zero", as_of, 5.0),
            (4, "bound", as_of - timedelta(hours=1), 4.0), (5, "bound", as_of, 5.0),
            (6, "tie", as_of - timedelta(hours=2), 2.0), (7, "tie", as_of - timedelta(hours=2), 4.0)]
    prices = spark.createDataFrame(rows, PRICES).withColumn("unit", F.lit("kg"))
    got = {r.input_key: (r.price_usd, r.pct_1h, r.pct_24h)
           for r in gold.commodity_latest(prices, as_of).collect()}
    assert got == {"young": (5.0, None, None), "zero": (5.0, None, None),
                   "bound": (5.0, 0.25, None), "tie": (4.0, 0.0, None)}


def test_baseline_skips_zero(spark):
    rows = [(1, "a", T0, 0.0), (2, "a", T0 + timedelta(1), 4.0), (3, "a", T0 + timedelta(2), 5.0),
            (4, "b", T0, 0.0)]
    got = {r.event_id: r.pct_vs_base for r in asof.pct_vs_baseline(
        spark.createDataFrame(rows, PRICES), "input_key", "event_ts", "price_usd").collect()}
    assert got == {1: -100.0, 2: 0.0, 3: 25.0, 4: None}


# ---- statuses and numbers ---------------------------------------------------------


@pytest.mark.parametrize(("event", "ordered", "received", "want"), [
    ("CREATED", 100.0, 0.0, "OPEN"), ("CREATED", 100.0, 99.0, "FULLY_RECEIVED"),
    ("CREATED", 100.0, 98.9, "PARTIALLY_RECEIVED"), ("CREATED", 100.0, 150.0, "FULLY_RECEIVED"),
    ("CANCELLED", 100.0, 100.0, "CANCELLED"), ("CREATED", 100.0, -5.0, "OPEN")])
def test_po_status(spark, event, ordered, received, want):
    assert one(spark, status.po_status(F.col("e"), F.col("o"), F.col("r")),
               e=event, o=ordered, r=received) == want


@pytest.mark.parametrize(("po", "got", "variance", "want"), [
    (None, 5.0, 0.0, "NO_PO"), (100.0, 0.0, 0.0, "PENDING_GR"), (100.0, 5.0, -2.0, "MATCHED"),
    (100.0, 5.0, 2.01, "VARIANCE"), (100.0, 5.0, None, "VARIANCE")])
def test_match_status(spark, po, got, variance, want):
    column = status.match_status(*[F.col(c).cast("double") for c in "pgv"])
    assert one(spark, column, p=po, g=got, v=variance) == want


def test_full_reversal_is_pending_again(spark):
    lines = "event_id string, event_ts timestamp_ntz, po_number int, po_item int"
    receipts = spark.createDataFrame([(1, 1, 30.0), (1, 1, -30.0)],
                                     "po_number int, po_item int, qty_received_g double")
    orders = spark.createDataFrame(
        [("o", T0, 1, 1, 10.0, 30.0, "CREATED", 9)],
        lines + ", net_value_usd double, quantity_g double, event_type string, sku int")
    invoices = spark.createDataFrame(
        [("i", T0, 1, 1, "D1", 0.0), ("j", T0, 7, 1, "D2", 0.0)],
        lines + ", invoice_doc_number string, variance_usd double")
    got = {r.invoice_doc_number: r.match_status
           for r in gold.invoice_matching(invoices, orders, receipts).collect()}
    assert got == {"D1": "PENDING_GR", "D2": "NO_PO"}


@pytest.mark.parametrize(("value", "want"), [
    (12.0, "CAUTION"), (11.9, "ALERT"), (15.0, "NOMINAL"), (27.0, "NOMINAL"), (27.1, "CAUTION"),
    (30.0, "CAUTION"), (30.1, "ALERT")])
def test_sensor_bounds(spark, value, want):
    readings = spark.createDataFrame(
        [("e", T0, "r", "temperature", value, "C"), ("f", T0, "r", "unknown", value, "C")],
        "event_id string, event_ts timestamp_ntz, room_id string, sensor_type string, "
        "value double, unit string")
    got = {r.sensor_type: r.status for r in gold.iot_latest(readings).collect()}
    assert got == {"temperature": want, "unknown": "NOMINAL"}


@pytest.mark.parametrize(("trend", "on_hand", "reorder", "score", "want"), [
    (0.01, 90.0, 100.0, 0.85, "REVIEW"), (0.011, 90.0, 100.0, 0.1, "BUY_NOW"),
    (-0.01, 90.0, 100.0, 0.1, "REVIEW"), (-0.011, 90.0, 100.0, 0.1, "WAIT"),
    (-0.011, 80.0, 100.0, 0.1, "REVIEW"), (None, 49.0, 100.0, None, "BUY_NOW"),
    (None, 60.0, 100.0, None, "REVIEW"), (-0.5, 90.0, 100.0, 0.86, "BUY_NOW")])
def test_decision(spark, trend, on_hand, reorder, score, want):
    column = status.buy_decision(*[F.col(c).cast("double") for c in "tors"])
    assert one(spark, column, t=trend, o=on_hand, r=reorder, s=score) == want


@pytest.mark.parametrize(("billed", "expected", "want"), [
    (101.0, 100.0, "OK"), (99.0, 100.0, "OK"), (105.0, 100.0, "REVIEW"),
    (105.1, 100.0, "DISPUTE"), (5.0, None, "DISPUTE"), (0.0, 0.0, "DISPUTE")])
def test_reconcile_bounds(spark, billed, expected, want):
    invoices = spark.createDataFrame(
        [("R", T0, "P", "s", billed, None, None, None, "NEW", None)],
        "reconciliation_id string, received_ts timestamp_ntz, po_id string, supplier_id string, "
        "invoiced_amount_usd double, expected_amount_usd double, variance_usd double, "
        "variance_pct double, status string, agent_notes string")
    drafts = spark.createDataFrame([("P", expected)], "po_id string, total_cost_usd double")
    row = workflow.reconcile(invoices, drafts).first()
    assert row.status == want
    if not expected:
        assert (row.variance_usd, row.variance_pct) == (billed, 100.0)
        assert row.agent_notes == "No matching PO total found"


@pytest.mark.parametrize(("grams", "pack", "fallback", "want"), [
    (100.0, 30.0, 7, 3), (10.0, 30.0, 7, 7), (10.0, 30.0, 0, 10), (None, 30.0, None, 10),
    (-500.0, 30.0, 7, 1)])
def test_packs_down(spark, grams, pack, fallback, want):
    column = numbers.packs_down(F.col("g").cast("double"), F.col("p"), F.col("f").cast("int"))
    assert one(spark, column, g=grams, p=pack, f=fallback) == want


def test_numbers_on_missing_values(spark):
    d = F.lit(None).cast("double")
    assert one(spark, numbers.shortfall(d, F.lit(5.0))) == 0.0
    assert one(spark, numbers.packs_up(F.lit(10.0), F.lit(3.0))) == 4
    assert one(spark, numbers.packs_up(F.lit(10.0), d)) is None
    assert one(spark, numbers.pct_change(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.gauge_fraction(F.lit(7.0), F.lit(5.0), F.lit(5.0))) == 1.0
    assert one(spark, numbers.gauge_fraction(F.lit(50.0), d, d)) == 0.5
    assert one(spark, numbers.flag(F.lit(None).cast("boolean"))) == 0.0


# ---- text -------------------------------------------------------------------------


def test_rationale_drops_unknown_facts(spark):
    d = F.lit(None).cast("double")
    got = one(spark, text.rationale(F.lit(1234.5), F.lit(2.5), d, F.lit(0.12345)))
    assert got == "on_hand_g=1,234 · reorder_g=2 · ml_score=0.123"
    assert one(spark, text.rationale(F.lit(1.0), d, F.lit(-0.0123), d)) == (
        "on_hand_g=1 · input24h=-1.23%")


@pytest.mark.parametrize(("name", "want"), [
    ("O'Brien Seeds", "orders@obrien.demo"), ("Solo", "orders@solo.demo"), ("", "orders@17.demo"),
    (None, "orders@17.demo"), ("  Two  words", "orders@two.demo")])
def test_order_address(spark, name, want):
    assert one(spark, text.order_address(F.col("n").cast("string"), F.lit(17)), n=name) == want


@pytest.mark.parametrize(("answer", "k", "note", "broken"), [
    ('```json\n{"k": 1, "note": "a\nb"}\n```', 1, "a\nb", False),
    ('Sure: {"k": 2, "note": "x"} - done', 2, "x", False),
    ('{"k": 3', None, None, None), ("none", None, None, None),
    ('{"k": }', None, None, True)])
def test_json_extract(spark, answer, k, note, broken):
    got = one(spark, text.json_extract(F.col("a"), "k INT, note STRING"), a=answer)
    if broken is None:
        assert got is None
    else:
        assert (got.k, got.note, got.malformed is not None) == (k, note, broken)


@pytest.mark.parametrize(("body", "intent"), [
    ("I am out of office", "OOF"), ("We regret to decline", "REJECT"),
    ("Here is our counter offer", "COUNTER"), ("We accept your terms", "ACCEPT"),
    ("Price: $5 per pack of 10 g", "QUOTE"), ("Your terms are unacceptable", "REJECT"),
    ("A rare encounter", "QUOTE"), ("We do not accept this", "REJECT"),
    ("We can't really accept", "REJECT"), ("Confirmed.", "ACCEPT"), ("counter-offer: $3", "COUNTER")])
def test_reply_intent(spark, body, intent):
    assert one(spark, text.reply_intent(F.col("b")), b=body) == intent


@pytest.mark.parametrize(("reply", "price", "pack", "days"), [
    ("$1,250.00 per pack of 1,000 g, lead time 12 days", 1250.0, 1000.0, 12),
    ("lead time 99999999999", None, None, None), ("backpack of 5 g; $ 3", 3.0, None, None),
    ("Lead time: 7", None, None, 7)])
def test_reply_numbers(spark, reply, price, pack, days):
    got = one(spark, F.struct(text.reply_price(F.col("r")), text.reply_pack(F.col("r")),
                              text.reply_lead_days(F.col("r"))), r=reply)
    assert tuple(got) == (price, pack, days)


def test_packs_beyond_an_int(spark):
    assert one(spark, numbers.packs_up(F.lit(1e12), F.lit(1.0))) is None
    assert one(spark, numbers.packs_down(F.lit(1e12), F.lit(1.0), F.lit(4))) == 4


def test_ids_tell_parts_apart(spark):
    parts = [("a", "b|c"), ("a|b", "c"), ("a", None), (None, "a"), ("ab", ""), ("", "ab")]
    ids = {one(spark, text.stable_id("X", F.lit(a).cast("string"), F.lit(b).cast("string"))) for a, b in parts}
    assert len(ids) == len(parts) and all(len(i) == 34 for i in ids)


def test_repeated_keys_in_a_state_update(spark):
    current = spark.createDataFrame([(1, "a")], "k int, v string")
    delta = spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(ValueError):
        state.state_update(current, delta, "k", ["v"])


def test_reply_organic(spark):
    assert one(spark, text.reply_organic(F.lit("inorganic matter"))) is None
    assert one(spark, text.reply_organic(F.lit("non-organic"))) is False
    assert one(spark, text.reply_organic(F.lit("certified organic seed"))) is True
    assert one(spark, text.reply_organic(F.lit("not organic"))) is False
    assert one(spark, text.reply_organic(F.lit("seed"))) is None


# ---- time -------------------------------------------------------------------------


def test_lead_time_zero_is_a_week(spark):
    start = F.lit("2024-02-27 10:00:00").cast("timestamp_ntz")
    for lead, day in [(0, 5), (None, 5), (3, 1)]:
        got = one(spark, timing.needed_by(start, F.col("d").cast("int")), d=lead)
        assert (got.month, got.day) == (3, day)


def test_as_of_accepts_zones(spark):
    from datetime import timezone

    zoned = datetime(2024, 1, 1, 2, tzinfo=timezone(timedelta(hours=2)))
    assert timing.resolve(zoned) == datetime(2024, 1, 1)
    df = spark.range(1).select(F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"))
    assert df.where(timing.since(df, "ts", zoned, hours=0)).count() == 1
    assert df.where(timing.since(df, "ts", zoned, strict=True, hours=0)).count() == 0


def test_json_events_decode(spark):
    from harvestline.schemas import FEEDS

    df = spark.createDataFrame(
        [('{"event_id":"a","event_ts":1704067200000001,"input_key":"peat","price_usd":2.5}',)],
        "value string")
    row = readers.json_event_decode(df, "value", FEEDS["commodity_prices"]).first()
    assert row.event_ts == datetime(2024, 1, 1, 0, 0, 0, 1) and row.price_usd == 2.5
    assert row.source is None


# ---- views and state --------------------------------------------------------------


def test_expired_quote_does_not_hide_a_valid_one(spark):
    rows = [("old", T0, 1, 1, T0 + timedelta(60)), ("new", T0 + timedelta(1), 1, 1, T0 + timedelta(2)),
            ("edge", T0, 2, 1, T0 + timedelta(30))]
    quotes = spark.createDataFrame(rows, "event_id string, event_ts timestamp_ntz, sku int, "
                                         "supplier_id int, valid_until_ts timestamp_ntz")
    got = gold.supplier_quotes_current(quotes, T0 + timedelta(30)).collect()
    assert [r.event_id for r in got] == ["old"]


def test_low_stock_without_offers_stays(spark):
    stock = spark.createDataFrame(
        [(1, "A", 4.0, T0, 10.0, 50.0), (2, "A", 4.0, T0, None, 50.0), (3, "A", 10.0, T0, 10.0, None)],
        "sku int, room_id string, on_hand_g double, last_event_ts timestamp_ntz, "
        "reorder_point_g double, target_stock_g double")
    board = spark.createDataFrame(
        [], "sku int, supplier_id int, supplier_name string, pack_size_g double, "
            "unit_price_usd double, lead_time_days int, score double, rank int")
    trend = spark.createDataFrame([], "sku int, input_pct_24h double")
    got = {r.sku: r for r in gold.recommendations(stock, board, trend, T0).collect()}
    assert set(got) == {1, 3}
    assert got[1].recommended_supplier_id is None and got[1].total_cost_usd is None
    assert got[1].reorder_grams == 46.0 and got[3].reorder_grams == 0.0
    assert got[1].recommendation_id == "1-A-20240101000000"


def test_upsert_and_update(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    merged = state.dim_upsert(current, spark.createDataFrame(
        [(2, None, 9), (3, "c", 3)], "k int, v string, w int"), "k")
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    twice = spark.createDataFrame([(5, "x", 1), (5, "y", 1)], "k int, v string, w int")
    with pytest.raises(ValueError, match="repeats"):
        state.dim_upsert(current, twice, "k")
    delta = spark.createDataFrame([(1, None)], "k int, v string")
    kept = state.state_update(current, delta, "k", ["v"])
    assert {r.k: r.v for r in kept.collect()} == {1: "a", 2: "b"}
    wiped = state.state_update(current, delta, "k", ["v"], overwrite_null=True)
    assert {r.k: r.v for r in wiped.collect()} == {1: None, 2: "b"}


def test_rooms_take_their_worst_status(spark):
    rows = [("r1", "NOMINAL"), ("r1", "ALERT"), ("r1", "CAUTION"), ("r2", "CAUTION"), ("r3", "NOMINAL")]
    df = spark.createDataFrame(rows, "room_id string, status string").withColumn(
        "event_ts", F.lit(T0))
    got = {r.room_id: (r.room_status, r.alerts, r.cautions)
           for r in aggregates.room_status(df).collect()}
    assert got == {"r1": ("ALERT", 1, 1), "r2": ("CAUTION", 0, 1), "r3": ("NOMINAL", 0, 0)}
    assert tuple(aggregates.farm_overview(df).first()) == (3, 1, 1, 1)


def test_score_matches_formula(spark):
    import math

    row = dict(usd_per_gram=2.0, pack_size_g=10.0, lead_time_days=15, min_qty=1, on_time_pct=0.9,
               quality_score=0.8, demand_1h_trays=40, input_pct_24h=0.05, organic_cert_int=1.0)
    df = spark.createDataFrame([row, {**row, "usd_per_gram": 1.0}])
    got = [r.score for r in scoring.score_closed_form(df).orderBy("usd_per_gram").collect()]
    rest = (0.1 * math.exp(-0.35) + 0.15 * math.exp(-1) + 0.2 * 0.86 + 0.1 * math.tanh(1)
            + 0.1 * (0.5 + 0.5 * math.tanh(1)) + 0.05)
    want = [0.3 * math.exp(-1.2 * max(p / 1.5 - 0.9, 0)) + rest for p in (1.0, 2.0)]
    assert got == pytest.approx(want)


@pytest.mark.parametrize(("offered", "organic", "years", "score", "verdict"), [
    ("", False, 4, 0.235, "REJECTED"), ("lettuce, Kale", True, 5, 0.925, "APPROVED"),
    ("lettuce, stones", True, 0, 0.525, "SCREENING"), (None, None, None, 0.075, "REJECTED")])
def test_onboarding(spark, offered, organic, years, score, verdict):
    df = spark.createDataFrame(
        [("A", "n", "NL", offered, organic, years, "NEW", None, None)],
        "application_id string, supplier_name string, country string, offered_skus string, "
        "organic_cert boolean, years_in_biz int, status string, score double, agent_notes string")
    row = workflow.onboard_score(df).first()
    assert (row.score, row.status) == (pytest.approx(score), verdict)


def test_rfq_window_and_threads(spark):
    rec = spark.createDataFrame(
        [("r1", T0, 1, 7, "BUY_NOW"), ("r2", T0, 2, 7, "BUY_NOW"), ("r3", T0, 3, 7, "WAIT")],
        "recommendation_id string, created_ts timestamp_ntz, sku int, "
        "recommended_supplier_id int, decision string")
    outbox = spark.createDataFrame(
        [("e1", "t", T0 - timedelta(hours=23), 7, 1, "RFQ"),
         ("e2", "t", T0 - timedelta(hours=24), 7, 2, "RFQ"),
         ("e3", "t", T0, 7, 2, "COUNTER")],
        "email_id string, thread_id string, created_ts timestamp_ntz, supplier_id int, "
        "sku int, intent string")
    got = workflow.rfq_candidates(rec, outbox, T0).collect()
    assert [r.recommendation_id for r in got] == ["r2"]
    replies = spark.createDataFrame([("i", "t")], "reply_id string, thread_id string")
    assert joins.thread_rfq_join(replies, outbox).count() == 2  # two requests in one thread


def test_drafts_skip_unusable_quotes(spark):
    texts = ['{"unit_price_usd": 2.0, "pack_size_g": 10.0, "lead_time_days": 0}',
             '{"unit_price_usd": 2.0, "pack_size_g": 0}', '{"pack_size_g": 5}', "not json", None]
    rows = [(f"T{i}", f"m{i}", f"q{i}", "" if i == 0 else "s", "S", "x", "y", "QUOTE", T0, t)
            for i, t in enumerate(texts)]
    candidates = spark.createDataFrame(
        rows, "thread_id string, email_id string, rfq_email_id string, sku string, "
              "out_sku string, supplier_id string, out_supplier string, intent_detected string, "
              "received_ts timestamp_ntz, extracted_json string")
    recs = spark.createDataFrame([("S", T0, "r", 35.0, 4)],
                                 "sku string, created_ts timestamp_ntz, recommendation_id string, "
                                 "reorder_grams double, packs int")
    got = workflow.po_drafts(candidates, recs, T0).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.sku, row.supplier_id, row.packs, row.total_grams, row.total_cost_usd) == (
        "S", "y", 3, 30.0, 6.0)
    assert row.needed_by.isoformat() == "2024-01-08"
