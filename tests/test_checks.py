"""Every registered query against its checking SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(SQL))
def test_against_sql(spark, con, key):
    assert not compare(spark, con, key, QUERIES[key], SQL[key], FOLDER)


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, key):
    assert QUERIES[key](spark, FOLDER).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_leaderboard_ranks_are_dense(spark):
    from pyspark.sql import functions as F

    board = QUERIES["gd_supplier_leaderboard"](spark, FOLDER)
    per_sku = board.groupBy("sku").agg(F.max("rank").alias("top"), F.count("*").alias("n"),
                                       F.count_distinct("rank").alias("d"))
    assert per_sku.where("top <> n OR d <> n").count() == 0


def test_statuses_add_up(spark):
    from harvestline.sources import bindings

    lines = QUERIES["gd_open_po_lines"](spark, FOLDER)
    orders = bindings.load(spark, FOLDER, "purchase_orders")
    assert lines.count() == orders.select("po_number", "po_item").distinct().count()


def test_reconciliation_sides_with_model(spark):
    """The trained scorer stays close to the score it was trained on."""
    mae = QUERIES["model_mae"](spark, FOLDER).first()["mae"]
    assert 0 < mae < 0.1
