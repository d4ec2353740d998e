"""Streamed as-of changes against the batch operator: any split, late and shuffled rows, restarts."""

import pickle
import random
from datetime import datetime, timedelta

import pytest

from harvestline.operators import asof
from harvestline.session import scratch_path
from harvestline.streaming import asof as streamed, feeds
from harvestline.streaming.asof import stream_asof_change
from tests.test_streaming import drop_file, rows_of, stream

T0 = datetime(2024, 1, 1)
PRICES = "event_id string, input_key string, event_ts timestamp, price_usd double"
OUT = ["event_id", "input_key", "event_ts", "price_usd", "ref_value", "pct"]
HOUR = timedelta(hours=1)


def answers(spark, deliveries, lateness, horizon=HOUR):
    folder, out = scratch_path(spark, "prices"), scratch_path(spark, "changes")
    for rows in deliveries:
        drop_file(spark, rows, PRICES, folder)
        found = stream_asof_change(stream(spark, folder, PRICES, 100), "input_key", "event_ts", "price_usd", horizon,
                                   lateness=lateness)
        feeds.append_to(found, out, f"{out}-cp").awaitTermination()   # each delivery restarts the query
    return spark.read.schema(found.schema).parquet(out)


def batch(spark, rows, horizon=HOUR):
    return asof.asof_change(spark.createDataFrame(rows, PRICES), "input_key", "event_ts", "price_usd", horizon)


BEAT = ("beat", "beat", T0 + timedelta(days=400), 1.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_shuffled_rows_equals_the_batch(spark, seed):
    """NULL keys, NULL and zero prices, equal instants; one key holds half of the rows."""
    rng = random.Random(seed)
    rows = [(f"e{i:03d}", rng.choice(["hot", "hot", "a", None]), T0 + timedelta(minutes=5 * rng.randrange(120)),
             rng.choice([None, 0.0, float(rng.randrange(1, 9))])) for i in range(160)]
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, 159), 2))
    got = answers(spark, [rows[:cuts[0]], rows[cuts[0]:cuts[1]], rows[cuts[1]:], [BEAT]], "30 days")
    assert rows_of(got, *OUT) == rows_of(batch(spark, rows), *OUT)


def test_history_reaches_over_many_batches_and_is_cut(spark):
    """The watermark follows closely: each delivery answers what the one before brought."""
    rows = [(f"e{i:02d}", "k", T0 + timedelta(minutes=20 * i), float(i + 1)) for i in range(24)]
    parts = [rows[i:i + 4] for i in range(0, 24, 4)]
    got = answers(spark, [*parts, [BEAT]], "10 minutes")
    assert rows_of(got, *OUT) == rows_of(batch(spark, rows), *OUT)
    # a long pause: the value valid when the history begins is still there
    pause = [("p0", "k", T0, 5.0), ("p1", "k", T0 + timedelta(days=9), 7.0), ("p2", "k", T0 + timedelta(days=20), 9.0)]
    got = answers(spark, [[r] for r in pause] + [[BEAT]], "10 minutes")
    assert rows_of(got, *OUT) == rows_of(batch(spark, pause), *OUT)


def test_rows_wait_for_the_watermark_and_need_a_time(spark):
    rows = [("a", "k", T0, 1.0), ("b", "k", T0 + 2 * HOUR, 2.0), ("none", "k", None, 3.0)]
    got = answers(spark, [rows], "1 hour")
    assert [r.event_id for r in got.collect()] == ["a"]
    assert answers(spark, [[]], "1 hour").count() == 0


def test_keys_and_ties_may_be_numbers(spark):
    folder, out = scratch_path(spark, "numbers"), scratch_path(spark, "changes")
    schema = "event_id long, input_key int, event_ts timestamp, price_usd double, ref_value double"
    rows = [(9, 1, T0, 4.0, 0.0), (10, 1, T0, 5.0, 0.0), (11, 1, T0 + HOUR, 10.0, 0.0), (12, 2, T0 + 400 * HOUR, 1.0, 0.0)]
    drop_file(spark, rows, schema, folder)
    found = stream_asof_change(stream(spark, folder, schema), "input_key", "event_ts", "price_usd", HOUR)
    feeds.append_to(found, out, f"{out}-cp").awaitTermination()
    got = {r.event_id: (r.ref_value, r.pct) for r in spark.read.schema(found.schema).parquet(out).collect()}
    assert got == {9: (None, None), 10: (None, None), 11: (5.0, 1.0)}


def test_a_hot_key_is_held_hour_by_hour(spark):
    """A worker holds some arriving rows, or an hour and a horizon of them, however many wait."""
    class Held:
        def __init__(self, kept):
            self.kept = kept

        def exists(self):
            return "" in self.kept

        def get(self):
            return self.kept[""]

        def update(self, value):
            self.kept[""] = value

        def clear(self):
            self.kept.clear()

        def getValue(self, key):
            return self.kept[key]

        def updateValue(self, key, value):
            self.kept[key] = value

        def removeKey(self, key):
            del self.kept[key]

    class Handle:
        def getMapState(self, *_):
            return Held({})

        getValueState = getMapState

        def registerTimer(self, _):
            pass

        deleteTimer = registerTimer

    import pandas as pd

    class Watermark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    days, step = 20, 30_000_000     # a row every 30 seconds: 120 an hour
    at = pd.Series(range(0, days * 24 * streamed.SPAN, step), dtype="int64").sample(frac=1, random_state=1)
    frame = pd.DataFrame({"at": at, "tie": at, "held": at.astype("float64")})
    key = streamed.AsOf(streamed.SPAN)
    key.init(Handle())
    assert list(key.handleInputRows(("k",), iter([frame[:20_000], frame[20_000:]]), Watermark(0))) == []
    found = list(key.handleExpiredTimer(("k",), Watermark(days * 24 * streamed.SPAN // 1000 + 1), None))
    assert max(map(len, found)) <= 120 and sum(map(len, found)) == len(at)
    whole = pd.concat(found)
    assert (whole["at"].diff().dropna() == step).all()
    assert (whole["ref"].dropna() == whole["at"][120:] - streamed.SPAN).all() and whole["ref"].isna().sum() == 120
    assert not key.waiting.kept and len(pickle.loads(key.past.get()[0])[0]) <= 121
