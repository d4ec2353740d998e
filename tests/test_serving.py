"""Parameters of the serving reads, thread shapes, sinks and model versions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harvestline import schemas
from harvestline.plans import model, serving
from harvestline.session import scratch_path
from harvestline.sources import sinks

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize(("call", "bad"), [
    (lambda d, v: serving.q_leaderboard(d, top=v), [0, 21]),
    (lambda d, v: serving.q_demand(d, T0, hours=v), [0, 169]),
    (lambda d, v: serving.q_recommendations(d, limit=v), [0, 501]),
    (lambda d, v: serving.q_po_lines(d, limit=v), [0, 1001]),
    (lambda d, v: serving.q_invoice_matching(d, limit=v), [0, 1001]),
    (lambda d, v: serving.q_threads(d, d, limit=v), [0, 201]),
    (lambda d, v: serving.q_po_drafts(d, limit=v), [0, 501]),
    (lambda d, v: serving.q_runs(d, limit=v), [0, 501])])
def test_ranges_are_checked(spark, call, bad):
    for value in bad:
        with pytest.raises(ValueError, match="must be between"):
            call(spark.range(1), value)


def mailboxes(spark):
    out = spark.createDataFrame(
        [("o1", "both", T0, "RFQ"), ("o2", "out", T0, "RFQ"), ("o3", "both", T0 + timedelta(5), "RFQ")],
        "email_id string, thread_id string, created_ts timestamp_ntz, intent string")
    came = spark.createDataFrame(
        [("i1", "both", T0 + timedelta(2), "QUOTE", True), ("i2", "in", T0, None, None)],
        "email_id string, thread_id string, received_ts timestamp_ntz, intent_detected string, "
        "processed boolean").withColumn("extracted_json", F.lit(None).cast("string"))
    rest = {c: F.lit("x") for c in ("supplier_id", "supplier_email", "subject", "body_md", "sku")}
    return (out.withColumns({**rest, "sent_by": F.lit("a"), "status": F.lit("SENT")}),
            came.withColumns(rest))


def test_threads(spark):
    got = {r.thread_id: (r.side, r.intent, r.last_ts)
           for r in serving.q_threads(*mailboxes(spark)).collect()}
    assert got == {"both": ("OUT", "RFQ", T0 + timedelta(5)), "out": ("OUT", "RFQ", T0),
                   "in": ("IN", None, T0)}


def test_one_thread_in_order(spark):
    rows = serving.q_thread(*mailboxes(spark), "both").collect()
    assert [(r.email_id, r.side, r.sent_by) for r in rows] == [
        ("o1", "OUT", "a"), ("i1", "IN", None), ("o3", "OUT", "a")]


def test_applications_without_status_are_limited(spark):
    df = spark.range(80).select(F.col("id").alias("application_id"), F.lit(T0).alias("submitted_ts"),
                                F.lit("NEW").alias("status"))
    assert serving.q_applications(df).count() == 50
    assert serving.q_applications(df, status="new").count() == 80


def test_budget_of_an_unknown_period(spark):
    ledger = spark.createDataFrame([], schemas.STATE["budget_ledger"])
    assert serving.q_budget(ledger, "2024-01").count() == 0


def test_snapshot_refuses_repeated_keys(spark):
    target = scratch_path(spark, "serving")
    good = spark.createDataFrame([(1, "a"), (2, "b")], "sku int, v string")
    sinks.snapshot_sync(good, target, ["sku"])
    with pytest.raises(ValueError, match="repeats"):
        sinks.snapshot_sync(good.unionByName(good), target, ["sku"])
    assert spark.read.parquet(target).count() == 2  # the broken snapshot never arrived
    sinks.snapshot_sync(good.where("sku = 1"), target, ["sku"])
    assert spark.read.parquet(target).count() == 1


def test_state_schemas_name_the_serving_columns():
    for table, columns in schemas.REQUIRED_COLUMNS.items():
        if table in schemas.STATE:
            assert set(columns) <= set(schemas.STATE[table].names)


def test_alias_moves_between_versions(spark):
    root = scratch_path(spark, "aliases")
    with pytest.raises(LookupError):
        model.resolve_alias(spark, root, "m", "prod")
    for version in (1, 2, 1):
        model.move_alias(spark, root, "m", "prod", version)
    model.move_alias(spark, root, "m", "test", 2)
    assert model.resolve_alias(spark, root, "m", "prod") == 1
    assert model.resolve_alias(spark, root, "m", "test") == 2


def test_feature_columns_are_checked(spark):
    with pytest.raises(ValueError, match="missing"):
        model.check_features(spark.range(1))


def test_scratch_can_be_dropped(spark):
    import os

    from harvestline import session

    mine = dict(session._SCRATCH)
    session._SCRATCH.clear()
    path = scratch_path(spark, "dropped")
    spark.range(3).write.parquet(path)
    assert session.drop_scratch(spark) == 1
    assert not os.path.exists(path.removeprefix("file:"))
    session._SCRATCH.update(mine)
