"""Properties of physical plans that matter at scale."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from harvestline.checks import gold as views
from harvestline.checks.registry import PLAIN, Tables

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(entry.__file__).parent
# the stream and model queries act while they are built
LAZY = sorted(k for k in PLAIN
              if not k.startswith(("stream", "gbt", "model", "boosted", "p2p", "late", "at_least", "mirror")))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", LAZY)
def test_no_cartesian_plans(spark, key):
    text = plan(PLAIN[key](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("key", ["latest_per_key", "gd_iot_latest", "top_n_per_group",
                                 "last_n_samples", "thread_rollup"])
def test_groups_are_limited_before_the_shuffle(spark, key):
    text = plan(PLAIN[key](spark, FOLDER))
    assert re.search(r"Exchange hashpartitioning.*\n.*WindowGroupLimit.*Partial", text)


@pytest.mark.parametrize(("key", "filters", "columns"), [
    ("lookback", ["GreaterThanOrEqual(ts,"], {"event_id", "ts", "value"}),
    ("valid_now", [], {"l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"}),
    ("receipts_sum", ["EqualTo(l_linestatus,F)"],
     {"l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"}),
    ("silver_iot", ["IsNotNull(value)"], {"event_id", "ts", "user_id", "event_type", "value"}),
])
def test_filters_and_columns_reach_the_scan(spark, key, filters, columns):
    df = PLAIN[key](spark, FOLDER)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = "".join(re.findall(r"PushedFilters: (.*)", text))
    assert all(f in pushed for f in filters), pushed
    read = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == columns


def test_as_of_changes_take_one_scan(spark):
    t = Tables(spark, FOLDER)
    assert plan(views.prices(t)).count("FileScan parquet") == 1


def test_one_shuffle_serves_both_as_of_windows(spark):
    text = plan(PLAIN["asof_each_row"](spark, FOLDER))
    assert "_slot" in text and text.count("Window [") <= 4
    assert text.count("FileScan parquet") <= 3  # events once, and once for what buckets close with


def test_bucketed_lines_join_without_a_shuffle(spark):
    from harvestline.operators import joins
    from harvestline.session import scratch_path
    from harvestline.sources import sinks

    t = Tables(spark, FOLDER)
    stored = {
        n: sinks.bucketed(getattr(t, n), f"bucketed_{n}", scratch_path(spark, n), 4, joins.LINE)
        for n in ("purchase_orders", "goods_receipts")
    }
    state = joins.line_state(stored["purchase_orders"], stored["goods_receipts"])
    assert "Exchange hashpartitioning" not in plan(state)
    direct = joins.line_state(t.purchase_orders, t.goods_receipts)
    assert state.exceptAll(direct).count() == 0 and direct.exceptAll(state).count() == 0
    for n in stored:
        spark.sql(f"DROP TABLE bucketed_{n}")


def test_sources_keep_to_the_rules():
    for path in [*ROOT.glob("harvestline/**/*.py"), ROOT / "__spark_entry__.py"]:
        code = path.read_text()
        assert "localCheckpoint" not in code, path
        assert "crossJoin" not in code, path
        assert ".toPandas(" not in code, path
        assert ".rdd" not in code, path
        for found in re.findall(r"broadcast\(.*", code):  # llm names its own bounds
            assert path.name == "joins.py" or "llm" in path.parts, (path, found)


@pytest.mark.parametrize(("key", "exchanges"), [
    ("gd_supplier_quotes_current", 1), ("gd_iot_latest", 1), ("gd_inventory_snapshot", 1), ("gd_commodity_latest", 1)])
def test_views_of_newest_rows_shuffle_once(spark, key, exchanges):
    """No duplicate removal in front of the group limit."""
    assert len(re.findall(r"Exchange hashpartitioning", plan(PLAIN[key](spark, FOLDER)))) == exchanges


def test_matching_shuffles_each_side_once_per_key(spark):
    """No table of all lines is shuffled anew for the join with invoices; digests of mirrors are bytes."""
    from harvestline.sources import changes

    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        text = plan(PLAIN["gd_invoice_matching"](spark, FOLDER))
    finally:
        spark.conf.set(limit, before)
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 5   # six with a full join in front
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    assert changes._digests(rows, ["k"], "new").schema["new_digest"].dataType.simpleString() == "binary"
