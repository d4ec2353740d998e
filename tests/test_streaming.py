"""Streams against their batch forms: several files, replays, late rows, restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harvestline.operators import aggregates, latest
from harvestline.plans import gold, silver
from harvestline.session import scratch_path
from harvestline.sources import readers, sinks
from harvestline.streaming import feeds, views
from tests.test_budget import by_hand

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id string, event_ts timestamp, sku string, room_id string, on_hand_g double"
DEMAND = "event_id string, event_ts timestamp, sku string, trays int, grams_req double"


def rows_of(df, *order):
    return sorted(map(tuple, df.select(*order).collect()), key=repr)


def drop_file(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stock_rows(seed, n):
    rng = random.Random(seed)
    return [(f"e{seed}-{i}", T0 + timedelta(minutes=rng.randrange(5000)), f"s{rng.randrange(4)}",
             f"r{rng.randrange(2)}", float(rng.randrange(-1, 50))) for i in range(n)]


@pytest.fixture
def feed(spark):
    """Three files; the second repeats rows of the first."""
    folder = scratch_path(spark, "feed")
    files = [stock_rows(1, 40), stock_rows(2, 40) + stock_rows(1, 10), stock_rows(3, 40)]
    for rows in files:
        drop_file(spark, rows, SCHEMA, folder)
    return folder, [r for rows in files for r in rows]


def stream(spark, folder, schema, files=1):
    parsed = spark.createDataFrame([], schema).schema
    return readers.stream_source(spark, folder, parsed, max_files=files)


def run_append(spark, df, label):
    out = scratch_path(spark, label)
    feeds.append_to(df, out, f"{out}-cp").awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@pytest.mark.parametrize("lateness", [None, "10 days"])
def test_silver_equals_batch(spark, feed, lateness):
    folder, rows = feed
    got = run_append(spark, feeds.stream_silver(
        "inventory_events", stream(spark, folder, SCHEMA), lateness), "silver")
    batch = silver.silver("inventory_events", spark.createDataFrame(rows, SCHEMA))
    assert rows_of(got, "event_id", "on_hand_g") == rows_of(batch, "event_id", "on_hand_g")
    assert got.count() == len({r[0] for r in rows if r[4] >= 0})


def test_bounded_dedup_drops_rows_behind_the_watermark(spark):
    folder = scratch_path(spark, "late")
    source = stream(spark, folder, SCHEMA)
    out = scratch_path(spark, "late-out")

    def deliver(rows):
        drop_file(spark, rows, SCHEMA, folder)
        feeds.append_to(feeds.stream_dedup_bounded(source, lateness="1 hour"), out,
                        f"{out}-cp").awaitTermination()

    deliver([("a", T0, "s", "r", 1.0), ("b", T0 + timedelta(hours=5), "s", "r", 1.0)])
    deliver([("late", T0 + timedelta(minutes=1), "s", "r", 1.0),
             ("fresh", T0 + timedelta(hours=6), "s", "r", 1.0),
             ("b", T0 + timedelta(hours=5), "s", "r", 1.0)])
    assert {r.event_id for r in spark.read.parquet(out).collect()} == {"a", "b", "fresh"}


def test_latest_is_incremental(spark, feed):
    folder, rows = feed
    out = scratch_path(spark, "latest")
    source = stream(spark, folder, SCHEMA)

    def catch_up():
        views.stream_latest(source, ["sku", "room_id"], out, f"{out}-cp").awaitTermination()
        return views.newest_versions(spark, out, ["sku", "room_id"])

    columns = ["sku", "room_id", "event_id", "on_hand_g"]
    want = latest.latest_per_key(spark.createDataFrame(rows, SCHEMA), ["sku", "room_id"])
    assert rows_of(catch_up(), *columns) == rows_of(want, *columns)
    # a restart takes only the new file; an old row does not win
    more = [("z", T0 + timedelta(days=30), "s0", "r0", 7.0), ("y", T0, "s1", "r1", 9.0)]
    drop_file(spark, more, SCHEMA, folder)
    want = latest.latest_per_key(spark.createDataFrame(rows + more, SCHEMA), ["sku", "room_id"])
    assert rows_of(catch_up(), *columns) == rows_of(want, *columns)


def test_joined_view_follows_the_feed(spark, feed):
    folder, rows = feed
    state, target = scratch_path(spark, "view"), scratch_path(spark, "target")
    dim = spark.createDataFrame(
        [(f"s{i}", "n", "c", 25.0, 5.0, 60.0, True) for i in range(3)],
        "sku string, sku_name string, crop_type string, reorder_point_g double, "
        "safety_stock_g double, target_stock_g double, organic_preferred boolean")
    seen = []

    def publish(current, batch_id):
        sinks.snapshot_sync(gold.inventory_snapshot(current, dim), target, ["sku", "room_id"])
        seen.append(batch_id)

    views.stream_latest_view(stream(spark, folder, SCHEMA), ["sku", "room_id"], state, publish,
                             f"{state}-cp").awaitTermination()
    assert seen == [0, 1, 2]
    want = gold.inventory_snapshot(spark.createDataFrame(rows, SCHEMA), dim)
    columns = ["sku", "room_id", "on_hand_g", "reorder_point_g"]
    assert rows_of(spark.read.parquet(target), *columns) == rows_of(want, *columns)


def test_replayed_batch_overwrites_itself(spark):
    path = scratch_path(spark, "replay")
    df = spark.range(5)
    for _ in range(2):
        sinks.write_batch(df, path, 0)
    sinks.write_batch(df, path, 1)
    assert sinks.read_batches(spark, path).count() == 10
    assert views.newest_versions(spark, path, ["id"]).count() == 5


def test_tumbling_equals_batch_and_closes_hours(spark):
    folder, out = scratch_path(spark, "demand"), scratch_path(spark, "demand-out")
    source = stream(spark, folder, DEMAND)

    def deliver(rows):
        drop_file(spark, rows, DEMAND, folder)
        views.stream_tumbling(source, out, f"{out}-cp", lateness="1 hour").awaitTermination()

    def at(hours):
        return T0 + timedelta(hours=hours)

    first = [("a", at(0.1), "s", 2, 1.0), ("b", at(0.9), "s", 3, 1.0), ("c", at(1.2), "t", 1, 1.0)]
    deliver(first)
    deliver([("d", at(0.5), "s", 10, 1.0)])                      # late but within the watermark
    deliver([("e", at(9), "s", 1, 1.0)])
    deliver([("f", at(0.2), "s", 100, 1.0)])                     # behind it: dropped
    kept = [*first, ("d", at(0.5), "s", 10, 1.0), ("e", at(9), "s", 1, 1.0)]
    want = aggregates.demand_tumbling(spark.createDataFrame(kept, DEMAND))
    got = views.newest_versions(spark, out, ["sku", "hour_ts"])
    assert rows_of(got, "sku", "hour_ts", "trays") == rows_of(want, "sku", "hour_ts", "trays")


def test_budget_over_several_batches(spark):
    schema = "po_id string, created_ts timestamp, total_cost_usd double"
    rng = random.Random(9)
    rows = [(f"P{i:03d}", T0 + timedelta(hours=9 * i), round(rng.uniform(1, 400), 2))
            for i in range(240)]
    folder, out = scratch_path(spark, "drafts"), scratch_path(spark, "decided")
    source = stream(spark, folder, schema)
    for i in range(0, 240, 80):   # delivered in time order, one file and one run each
        drop_file(spark, rows[i:i + 80], schema, folder)
        views.stream_budget(source, f"{out}-d", f"{out}-l", f"{out}-cp",
                            amount=3000.0).awaitTermination()
    named = [(p, ts.strftime("%Y-%m"), ts, c) for p, ts, c in rows]
    want = by_hand(named, {r[1]: 3000.0 for r in named})
    got = {r.po_id: (r.approved, r.balance_after)
           for r in sinks.read_batches(spark, f"{out}-d").collect()}
    assert got == want
    last = views.newest_versions(spark, f"{out}-l", ["period_ym"])
    assert last.where(F.col("balance_usd") < 0).count() == 0
