"""Jobs made slice by slice give what they give at once, and leave less on the disk."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harvestline import session
from harvestline.plans import gold
from harvestline.session import cut_lineage, cut_slices, scratch_path, slice_of, slices_for
from harvestline.sources import sinks
from harvestline.streaming import ids

T0 = datetime(2024, 1, 1)


def feeds(spark):
    """Orders, receipts and invoices with copies, moved lines, missing orders and lines without a key, in files."""
    n = spark.range(400)
    line = [F.when(F.col("id") % 31 != 7, F.col("id") % 90).alias("po_number"), (F.col("id") % 3).cast("int").alias("po_item")]
    when = (F.lit(T0) + F.make_dt_interval(F.col("id") % 11)).alias("event_ts")
    event = F.concat(F.lit("e"), F.col("id") % 350).alias("event_id")
    value = (F.col("id") % 17 * 10.0)
    orders = n.select(event, when, *line, value.alias("net_value_usd"), value.alias("quantity_g"),
                      F.lit("CREATED").alias("event_type"), (F.col("id") % 5).alias("sku"))
    receipts = n.select(event, *line, (F.col("id") % 7 * 1.5).alias("qty_received_g"))
    invoices = n.select(event, when, F.when(F.col("id") % 41 != 3, F.concat(F.lit("i"), F.col("id") % 120)).alias("invoice_doc_number"),
                        *line, (F.col("id") % 13 - 6.0).alias("variance_usd"))
    return [cut_lineage(df.union(df), "feed") for df in (invoices, orders, receipts)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matching_in_slices_gives_all_rows(spark, monkeypatch):
    tables = feeds(spark)
    whole = gold.invoice_matching(*tables)
    want = rows_of(whole)
    monkeypatch.setattr(session, "SLICE_BYTES", 20_000)
    assert 1 < slices_for(["po_number"], *tables) < 20
    sliced = gold.invoice_matching(*tables)
    assert sliced.columns == whole.columns and rows_of(sliced) == want
    # no shuffle is left to the reader: each slice's is gone by then
    assert "Exchange" not in sliced._jdf.queryExecution().executedPlan().toString()


def test_slices_hold_every_row_once(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", None), (None, None), ("a", 2)], "k string, v int")
    parts = [slice_of(rows, ["k", "v"], i, 3) for i in range(3)]
    assert rows_of(cut_slices(parts, "slices")) == rows_of(rows)


def test_unknown_sizes_and_keys_of_several_types_are_one_slice(spark, monkeypatch):
    monkeypatch.setattr(session, "SLICE_BYTES", 1)
    known = cut_lineage(spark.range(5), "known")
    assert slices_for(["id"], known) == session.MOST_SLICES
    assert slices_for(["id"], known, known.select(F.col("id").cast("int").alias("id"))) == 1
    assert slices_for(["id"], spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "id int")) == 1


@pytest.mark.parametrize("ts", [None, "event_ts"])
def test_ids_of_a_large_batch_are_taken_in_slices(spark, monkeypatch, ts):
    monkeypatch.setattr(ids, "slices_for", lambda keys, rows: 3)
    seen = ids.SeenIds(spark, scratch_path(spark, "ids"), ts=ts, per_part=1000, buckets=4)
    rows = [(None if i % 20 == 3 else f"a{i % 50}", T0 + timedelta(hours=i % 50), i) for i in range(100)]
    batch = spark.createDataFrame(rows, "event_id string, event_ts timestamp, v int")
    got = rows_of(seen.unseen(batch, 0))
    least = {}
    for row in sorted(rows, key=lambda r: r[1:]):
        least.setdefault((row[0], row[1].date() if ts else None), row)
    assert got == sorted(least.values(), key=repr)
    assert seen.unseen(batch, 1).count() == 0


def test_id_files_hold_ids_only(spark):
    """Hashes are made anew when ids are read; sorted, the ids take few bytes."""
    seen = ids.SeenIds(spark, scratch_path(spark, "ids"), ts=None, buckets=2, per_part=20_000)
    rows = spark.range(20_000).select(F.concat_ws("-", F.col("id") * 7, F.col("id") % 7, F.col("id") % 900).alias("event_id"))
    seen.unseen(rows, 0)
    assert seen.size()["ids"] < 8 * 20_000
    assert seen.unseen(rows.limit(100), 1).count() == 0


def test_delivered_files_are_dropped_and_the_folder_stays(spark):
    folder = scratch_path(spark, "delivered")
    sinks.append_sink(spark.range(5), folder)
    sinks.drop_delivered(spark, folder)
    assert os.listdir(folder) == []
