"""The dashboard kept by signed changes against the batch row over all rows so far."""

import random
from datetime import datetime, timedelta

import pytest

from harvestline.operators import aggregates, latest
from harvestline.session import scratch_path
from harvestline.streaming.dashboard import FEEDS, KEYED, Dashboard
from tests.test_streaming import drop_file, rows_of, stream

T0 = datetime(2024, 1, 1)
SCHEMAS = {
    "inventory": "event_id string, event_ts timestamp, sku string, room_id string, on_hand_g double",
    "recommendations": "recommendation_id string, created_ts timestamp, decision string, total_cost_usd double",
    "drafts": "po_id string, changed_ts timestamp, status string",
    "inbox": "email_id string, changed_ts timestamp, processed boolean",
    "prices": "event_id string, event_ts timestamp",
}
COLUMNS = ["skus_below_reorder", "buy_now_last_5m", "spend_pending_1h_usd", "last_market_tick", "po_drafts_open",
           "inbound_unprocessed"]


def moves(seed, batch):
    """Changes of one batch: around its own 40 minutes, some of them hours late, some repeated."""
    rng = random.Random(f"{seed}-{batch}")

    def at():
        late = rng.choice([0, 0, 0, 200])
        return T0 + timedelta(minutes=40 * batch + rng.randrange(40) - late, seconds=rng.randrange(60))

    def pick(*of):
        return rng.choice(of)

    rows = {
        "inventory": [(f"e{batch}-{i}", pick(at(), None) if i == 0 else at(), pick("a", "b", "z", None), pick("r1", "r2"),
                       pick(None, 1.0, 9.0, 50.0)) for i in range(8)],
        "recommendations": [(f"q{rng.randrange(12)}", at(), pick("BUY_NOW", "WAIT", None), pick(None, 0.1, 12.345678))
                            for _ in range(10)],
        "drafts": [(f"p{rng.randrange(6)}", at(), pick("DRAFT", "APPROVED", None)) for _ in range(6)],
        "inbox": [(f"m{rng.randrange(6)}", at(), pick(True, False, None)) for _ in range(6)],
        "prices": [(f"t{batch}-{i}", pick(at(), None)) for i in range(3)],
    }
    return {feed: of + of[:2] for feed, of in rows.items()}


def by_batch(spark, dim, seen, as_of):
    tables = {f: spark.createDataFrame(seen[f], SCHEMAS[f]) for f in FEEDS}
    for feed, (keys, ts, ties) in KEYED.items():
        tables[feed] = latest.latest_per_key(tables[feed], keys, ts, ties)
    stock = tables["inventory"].join(dim, "sku", "left")
    return rows_of(aggregates.kpi_summary(stock, tables["recommendations"], tables["prices"], tables["drafts"],
                                          tables["inbox"], as_of), *COLUMNS)


def rounded(rows):
    return [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]


@pytest.fixture
def dim(spark):
    return spark.createDataFrame([("a", 10.0), ("b", 5.0), ("c", None)], "sku string, reorder_point_g double")


def test_every_batch_gives_the_batch_row(spark, dim):
    board = Dashboard(spark, scratch_path(spark, "board"), dim, every=2)
    seen = {f: [] for f in FEEDS}
    for batch in range(5):
        rows, as_of = moves(1, batch), T0 + timedelta(minutes=40 * (batch + 1))
        part = {f: spark.createDataFrame(rows[f], SCHEMAS[f]) for f in FEEDS}
        board.add(part, batch, as_of)
        if batch == 3:   # replayed
            board.add(part, batch, as_of)
        for f in FEEDS:
            seen[f] += rows[f]
        assert rounded(rows_of(board.read(as_of), *COLUMNS)) == rounded(by_batch(spark, dim, seen, as_of))
    later = as_of + timedelta(minutes=45)   # windows expire though nothing arrives
    assert rounded(rows_of(board.read(later), *COLUMNS)) == rounded(by_batch(spark, dim, seen, later))
    with pytest.raises(ValueError):
        board.read(as_of - timedelta(minutes=1))
    # compaction left out what no reader may ask for
    base = spark.read.parquet(f"{board.facts.path}/_base/upto={board.facts.base()}")
    kept = base.where("fact IN ('buy_now', 'spend')").agg({"at": "min"}).first()[0]
    assert kept is None or kept > T0 + timedelta(minutes=40 * (board.facts.base() + 1)) - timedelta(hours=1)


def test_streams_over_restarts_and_feeds_that_rest(spark, dim):
    folders = {f: scratch_path(spark, f) for f in FEEDS}
    out, seen = scratch_path(spark, "board"), {f: [] for f in FEEDS}
    assert Dashboard(spark, out, dim).read(T0) is None
    for batch in range(2):
        as_of = T0 + timedelta(minutes=40 * (batch + 1))
        for f, rows in moves(2, batch).items():
            if batch == 0 and f in ("drafts", "prices"):
                continue
            drop_file(spark, rows, SCHEMAS[f], folders[f])
            seen[f] += rows
        board = Dashboard(spark, out, dim)
        board.follow(f"{out}-cp", lambda: as_of,
                     **{f: stream(spark, folders[f], SCHEMAS[f]) for f in FEEDS}).awaitTermination()
        assert rounded(rows_of(board.read(as_of), *COLUMNS)) == rounded(by_batch(spark, dim, seen, as_of))
    with pytest.raises(ValueError):
        board.follow("unused", lambda: as_of, other=stream(spark, folders["inbox"], SCHEMAS["inbox"]))
