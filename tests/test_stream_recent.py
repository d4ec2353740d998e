"""Newest samples kept batch by batch against one pass over all rows."""

import random
from datetime import datetime, timedelta

import pytest

from harvestline.operators import aggregates, latest
from harvestline.session import scratch_path
from harvestline.streaming.recent import RecentSamples
from tests.test_streaming import drop_file, rows_of, stream

T0 = datetime(2024, 1, 1)
READINGS = "event_id string, event_ts timestamp, room_id string, sensor_type string, value double"
KEYS = ["room_id", "sensor_type"]


def readings(seed, n):
    rng = random.Random(seed)
    return [(f"e{seed}-{i:03d}", rng.choice([None, T0 + timedelta(minutes=rng.randrange(60))]) if i % 9 == 0
             else T0 + timedelta(minutes=rng.randrange(60)), rng.choice(["hot", "hot", "a", None]), "temp",
             rng.choice([None, float(rng.randrange(20))])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_newest_n(spark, seed):
    rows = readings(seed, 150)
    random.Random(seed).shuffle(rows)
    cuts = [0, *sorted(random.Random(seed).sample(range(1, 149), 6)), 150]
    kept = RecentSamples(spark, scratch_path(spark, "recent"), KEYS, 5, every=2)
    assert kept.read() is None
    for batch, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame(rows[a:b], READINGS)
        kept.add(part, batch)
        kept.add(part, batch)   # a replayed batch counts once
        want = latest.last_n_samples(spark.createDataFrame(rows[:b], READINGS), KEYS, 5)
        assert rows_of(kept.read(), *want.columns) == rows_of(want, *want.columns)
    assert kept.table.base() is not None
    # the base holds no more than n rows of a key
    base = spark.read.parquet(f"{kept.table.path}/_base/upto={kept.table.base()}")
    assert base.groupBy(*KEYS).count().where("count > 5").count() == 0
    hot = spark.createDataFrame([("hot",)], "room_id string")
    assert {r.room_id for r in kept.read(hot, ["room_id"]).collect()} == {"hot"}


def test_a_feed_over_restarts_gives_the_sparkline_of_the_batch(spark):
    folder, out = scratch_path(spark, "readings"), scratch_path(spark, "recent")
    kept, seen = RecentSamples(spark, out, KEYS, 7, every=2), []
    for seed in range(4):
        rows = readings(seed, 40)
        seen += rows
        drop_file(spark, rows, READINGS, folder)
        feed = stream(spark, folder, READINGS).where("value IS NOT NULL")
        kept.follow(feed, f"{out}-cp").awaitTermination()
        want = aggregates.sparkline_stats(spark.createDataFrame(seen, READINGS), 7)
        got = aggregates.sparkline_stats(kept.read(), 7)
        assert rows_of(got, *want.columns) == rows_of(want, *want.columns)


def test_a_batch_is_cut_before_its_shuffle_and_n_is_checked(spark):
    kept = RecentSamples(spark, scratch_path(spark, "recent"), KEYS, 3)
    plan = kept.fold(spark.createDataFrame(readings(1, 9), READINGS))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("Exchange hashpartitioning")) > 0
    with pytest.raises(ValueError):
        RecentSamples(spark, "unused", KEYS, 0)
