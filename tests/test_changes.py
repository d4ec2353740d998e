"""Change sets between snapshots and mirrors that take them."""

import random

import pytest

from harvestline.session import scratch_path
from harvestline.sources import changes

SCHEMA = "sku string, room int, v double, at timestamp"


def snapshots(spark, seed):
    rng = random.Random(seed)
    for _ in range(6):
        rows = {(f"s{k}", r): (rng.choice([None, 1.0, 2.0]), None) for k in range(6) for r in range(2) if rng.random() < 0.7}
        yield spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA), rows


def applied(old, change_rows):
    out = dict(old)
    for r in change_rows:
        if r._op == "delete":
            assert (r.sku, r.room) in out and r.v is None
            del out[r.sku, r.room]
        else:
            assert ((r.sku, r.room) in out) == (r._op == "update")
            out[r.sku, r.room] = (r.v, r["at"])
    return out


def test_changes_turn_the_old_snapshot_into_the_new(spark):
    previous = None
    for frame, rows in snapshots(spark, 1):
        if previous is not None:
            found = changes.change_set(previous[0], frame, ["sku", "room"]).collect()
            assert applied(previous[1], found) == rows
            # unchanged rows are not in it
            same = {k for k in rows if previous[1].get(k) == rows[k]}
            assert not same & {(r.sku, r.room) for r in found}
        previous = frame, rows


def test_mirror_follows_and_compacts(spark):
    mirror = changes.Mirror(spark, scratch_path(spark, "mirror"), ["sku", "room"], every=2)
    assert mirror.read() is None
    before = {}
    for frame, rows in snapshots(spark, 2):
        counts = mirror.sync(frame)
        assert {(r.sku, r.room): (r.v, r["at"]) for r in mirror.read().collect()} == rows
        assert sum(counts.values()) == len({k for k in {*rows, *before} if rows.get(k) != before.get(k)})
        before = rows
    assert mirror.sync(frame) == {} and mirror.table.base() is not None
    with pytest.raises(ValueError, match="repeats"):
        mirror.sync(frame.unionByName(frame))
    assert mirror.read().count() == len(before)
    # everything goes, something comes back
    assert set(mirror.sync(frame.limit(0))) <= {"delete"} and mirror.read().count() == 0
    mirror.sync(frame)
    assert mirror.read().count() == len(before)


def test_microseconds_and_null_keys_count(spark):
    old = spark.sql("SELECT cast(null AS string) AS k, timestamp'2024-01-01 00:00:00.000001' AS at")
    new = spark.sql("SELECT cast(null AS string) AS k, timestamp'2024-01-01 00:00:00.000002' AS at")
    assert [r._op for r in changes.change_set(old, new, ["k"]).collect()] == ["update"]
    assert changes.change_set(old, old, ["k"]).count() == 0
