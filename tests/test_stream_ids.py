"""Exact duplicate removal with ids kept in files behind Bloom filters."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harvestline.operators.quality import dedup_event_id
from harvestline.session import scratch_path
from harvestline.sources import sinks
from harvestline.streaming.ids import SeenIds
from tests.test_streaming import drop_file, rows_of, stream

T0 = datetime(2024, 1, 1)
EVENTS = "event_id string, event_ts timestamp, value double"
COLUMNS = ["event_id", "event_ts", "value"]


def events(seed, n, days=4):
    """Rows whose time follows from their id, some without id or time."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        k = rng.randrange(120)
        rows.append((None if k == 7 else f"e{k}", None if k % 11 == 0 else T0 + timedelta(hours=k % (24 * days)), float(k)))
    return rows


@pytest.mark.parametrize("ts, per_part", [("event_ts", 1000), (None, 1)])
def test_any_split_keeps_each_id_once(spark, ts, per_part):
    rows = events(per_part, 240)
    cuts = [0, *sorted(random.Random(3).sample(range(1, 239), 4)), 240]
    seen = SeenIds(spark, scratch_path(spark, "ids"), ts=ts, per_part=per_part, every=2)
    got = []
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(rows[a:b], EVENTS).coalesce(2)
        seen.fold(seen._parts(seen._keyed(part)), batch)
        first = rows_of(seen.unseen(part, batch), *COLUMNS)
        if batch == 2:   # a replayed batch does not take its own ids for seen ones
            assert rows_of(seen.unseen(part, batch), *COLUMNS) == first
        got += first
    want = dedup_event_id(spark.createDataFrame(rows, EVENTS))
    assert sorted(got, key=repr) == rows_of(want, *COLUMNS)
    days = ["2024-01-01", "2024-01-02"] if ts else ["1", "2"]
    assert all(len(seen.pieces("ids", p)) <= 3 for p in days)


def test_late_copies_over_restarts(spark):
    folder, out = scratch_path(spark, "feed"), scratch_path(spark, "once")
    old = [(f"a{i}", T0, float(i)) for i in range(30)]
    new = [(f"b{i}", T0 + timedelta(days=40), float(i)) for i in range(30)]
    for rows in (old, new, old[:10] + [("a99", T0, 99.0)], new + new):   # copies 40 days late
        drop_file(spark, rows, EVENTS, folder)
        seen = SeenIds(spark, f"{out}-ids", per_part=100, every=2)
        seen.follow(stream(spark, folder, EVENTS), out, f"{out}-cp").awaitTermination()
    want = spark.createDataFrame(old + new + [("a99", T0, 99.0)], EVENTS)
    assert rows_of(sinks.read_batches(spark, out), *COLUMNS) == rows_of(want, *COLUMNS)


def test_id_files_are_opened_only_after_a_hit(spark):
    seen = SeenIds(spark, scratch_path(spark, "ids"), per_part=10_000)
    opened, read = [], seen._read

    def watched(kind, parts, batch_id):
        opened.append((kind, tuple(parts)))
        return read(kind, parts, batch_id)

    seen._read = watched
    first = spark.range(200).select(F.concat(F.lit("x"), "id").alias("event_id"), F.lit(T0).alias("event_ts"))
    assert seen.unseen(first, 0).count() == 200
    fresh = spark.range(50).select(F.concat(F.lit("y"), "id").alias("event_id"), F.lit(T0).alias("event_ts"))
    assert seen.unseen(fresh, 1).count() == 50
    assert "ids" not in {kind for kind, _ in opened}
    both = first.limit(5).unionByName(fresh.withColumn("event_ts", F.lit(T0 + timedelta(days=1))))
    assert seen.unseen(both, 2).count() == 50   # the same ids on another day are other rows
    assert [parts for kind, parts in opened if kind == "ids"] == [("2024-01-01",)]


def test_filters_stay_small_and_seldom_err(spark):
    n = 40_000
    seen = SeenIds(spark, scratch_path(spark, "ids"), per_part=n)
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"), F.lit(T0).alias("event_ts"))
    seen.unseen(rows, 0)
    size = seen.size()
    assert 0 < size["filter"] < 2.5 * n and size["filter"] < size["ids"] / 10
    others = spark.range(n, 2 * n).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"), F.lit(T0).alias("event_ts"))
    assert seen._maybe(seen._keyed(others), 1).count() < 0.015 * n
    assert seen._maybe(seen._keyed(rows), 1).count() == n   # never misses one


def test_empty_batches_clashing_names_and_bad_sizes(spark):
    seen = SeenIds(spark, scratch_path(spark, "ids"))
    wide = "event_id string, event_ts timestamp, part int, hash int, piece int, id int, row int, block int, bits int"
    assert seen.unseen(spark.createDataFrame([], wide), 0).count() == 0
    rows = spark.createDataFrame([("a", T0, 1, 2, 3, 4, 5, 6, 7), ("a", T0, 1, 2, 3, 4, 5, 6, 8)], wide)
    assert [r.bits for r in seen.unseen(rows, 1).collect()] == [7]
    assert seen.unseen(rows, 2).count() == 0
    with pytest.raises(ValueError):
        SeenIds(spark, "unused", per_part=0)
