"""The star-schema test tables exposed as event feeds, dimensions and state tables.

Each binding is one projection over a whole table. The expressions are shared by Spark
and by the checking SQL: `to_duck` only rewrites the few names that differ.
"""

from __future__ import annotations

import re
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestline.sources.readers import batch_source

AS_OF_EVENTS = datetime(2024, 1, 31)
AS_OF_QUOTES = datetime(2001, 1, 1)
AS_OF_MAIL = datetime(2024, 1, 1, 0, 10)
PERIOD_BUDGET_USD = 2_000_000.0

# Bands and crop map for the event types and part types of the test tables. One sensor
# type and one crop are missing on purpose.
BANDS = [
    ("click", 20.0, 300.0, 50.0, 200.0, 0.0, 400.0),
    ("view", 20.0, 300.0, 50.0, 200.0, 0.0, 400.0),
    ("purchase", 20.0, 300.0, 50.0, 200.0, 0.0, 400.0),
    ("signup", 20.0, 300.0, 50.0, 200.0, 0.0, 400.0),
]
CROPS = [
    ("ECONOMY", "click"), ("MEDIUM", "view"), ("SMALL", "purchase"), ("LARGE", "signup"),
    ("STANDARD", "error"),
]
OFFERS = ["lettuce", "basil", "kale", "microgreens"]


class Binding(NamedTuple):
    source: str
    columns: dict[str, str]
    where: str | None = None


# one row of the table has one id: lines that share the four keys differ in their date
_LINE_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {day(l_shipdate)})"

BINDINGS: dict[str, Binding] = {
    "inventory_events": Binding("events", {
        "event_id": "event_id", "event_ts": "ts", "sku": "user_id", "room_id": "event_type",
        "on_hand_g": "value", "reason": "'ADJUST'",
    }),
    "commodity_prices": Binding("events", {
        "event_id": "event_id", "event_ts": "ts", "input_key": "event_type",
        "price_usd": "value", "unit": "'per_kg'", "currency": "'USD'",
    }),
    "demand_events": Binding("events", {
        "event_id": "event_id", "event_ts": "ts", "sku": "user_id", "zone_id": "event_type",
        "trays": "cast(1 + cast(get_json_object(props, '$.k') as int) % 4 as int)",
        "grams_req": "value",
    }),
    "iot_sensor_events": Binding("events", {
        "event_id": "event_id", "event_ts": "ts", "room_id": "user_id",
        "sensor_type": "event_type", "value": "value", "unit": "'u'",
    }),
    "supplier_quotes": Binding("lineitem", {
        "event_id": _LINE_ID, "event_ts": "l_shipdate", "supplier_id": "l_suppkey",
        "sku": "l_partkey", "pack_size_g": "l_quantity", "unit_price_usd": "l_extendedprice",
        "min_qty": "l_linenumber", "lead_time_days": "cast(1 + l_orderkey % 30 as int)",
        "valid_until_ts": "l_shipdate + make_dt_interval(900 + 30 * l_linenumber)",
        "organic": "l_returnflag = 'N'", "currency": "'USD'",
    }),
    "purchase_orders": Binding("lineitem", {
        "event_id": _LINE_ID, "event_ts": "l_shipdate", "po_number": "l_orderkey",
        "po_item": "l_linenumber",
        "event_type": "case when l_tax = 0.08D then 'CANCELLED' "
                      "when l_returnflag = 'A' then 'APPROVED' else 'CREATED' end",
        "supplier_id": "l_suppkey", "sku": "l_partkey", "quantity_g": "l_quantity",
        "unit_price_usd": "l_extendedprice / l_quantity", "net_value_usd": "l_extendedprice",
        "delivery_date_ts": "l_shipdate + make_dt_interval(30)",
    }),
    "goods_receipts": Binding("lineitem", {
        "event_id": _LINE_ID, "event_ts": "l_shipdate", "po_number": "l_orderkey",
        "po_item": "l_linenumber", "sku": "l_partkey",
        "qty_received_g": "case when l_returnflag = 'R' and l_tax >= 0.06D then -l_quantity "
                          "when l_returnflag = 'N' then l_quantity * 0.5D else l_quantity end",
        "movement_type": "case when l_returnflag = 'R' and l_tax >= 0.06D then '122' "
                         "else '101' end",
    }, "l_linestatus = 'F'"),
    "invoice_documents": Binding("lineitem", {
        "event_id": _LINE_ID, "event_ts": "l_shipdate",
        "invoice_doc_number": "concat_ws('-', l_orderkey, l_linenumber)",
        "po_number": "case when l_orderkey % 50 = 0 then -1 else l_orderkey end",
        "po_item": "l_linenumber", "supplier_id": "l_suppkey",
        "net_amount_usd": "l_extendedprice * (1 - l_discount / 2)",
        "variance_usd": "-l_extendedprice * l_discount / 2",
        "status": "case when l_linestatus = 'F' then 'POSTED' else 'PARKED' end",
    }, "l_returnflag <> 'R'"),
    "dim_sku": Binding("part", {
        "sku": "p_partkey", "sku_name": "p_name", "crop_type": "p_type",
        "reorder_point_g": "p_size * 3.0D", "safety_stock_g": "p_size * 1.0D",
        "target_stock_g": "p_size * 10.0D", "organic_preferred": "p_partkey % 2 = 0",
    }),
    "dim_supplier": Binding("supplier", {
        "supplier_id": "s_suppkey", "supplier_name": "s_name",
        "tier": "case s_suppkey % 3 when 0 then 'preferred' when 1 then 'qualified' "
                "else 'probation' end",
        "on_time_pct": "0.8D + (s_suppkey % 20) / 100.0D",
        "quality_score": "0.85D + (s_suppkey % 15) / 100.0D",
        "organic_cert": "s_suppkey % 2 = 1",
    }),
    "po_drafts": Binding("orders", {
        "po_id": "o_orderkey", "created_ts": "o_orderdate", "thread_id": "o_orderkey * 3",
        "sku": "o_custkey", "supplier_id": "o_custkey % 97", "packs":
        "cast(1 + o_orderkey % 20 as int)", "pack_size_g": "50.0D",
        "total_grams": "50.0D * (1 + o_orderkey % 20)",
        "unit_price_usd": "o_totalprice / (1 + o_orderkey % 20)",
        "total_cost_usd": "o_totalprice",
        "needed_by": "cast(o_orderdate as date)",
        "status": "case o_orderstatus when 'O' then 'DRAFT' when 'F' then 'APPROVED' "
                  "else 'REJECTED' end",
        "rationale": "o_orderpriority",
    }),
    "budget_ledger": Binding("orders", {
        "ledger_id": "concat('L', o_orderkey)",
        "entry_ts": "o_orderdate",
        "period_ym": "{month(o_orderdate)}",
        "category": "case o_orderkey % 4 when 0 then 'SEED' when 1 then 'SUBSTRATE' "
                    "when 2 then 'NUTRIENTS' else 'OVERHEAD' end",
        "delta_usd": "-o_totalprice", "balance_usd": "2000000.0D - o_totalprice",
        "po_id": "o_orderkey", "note": "o_orderpriority",
    }),
    "invoice_reconciliations": Binding("orders", {
        "reconciliation_id": "o_orderkey", "received_ts": "o_orderdate",
        "po_id": "case when o_orderkey % 40 = 0 then -1 else o_orderkey end",
        "supplier_id": "o_custkey % 97",
        "invoiced_amount_usd": "o_totalprice * (1 + ((o_orderkey % 13) - 6) * 1.1D / 100)",
        "status": "case when o_orderstatus = 'P' then 'PAID' else 'NEW' end",
    }),
    "email_outbox": Binding("conversations", {
        "email_id": "concat_ws('-', 'OUT', conv_id, turn)", "thread_id": "conv_id",
        "created_ts": "timestamp_ntz'2024-01-01 00:00:00' + {minutes(turn)}",
        "supplier_id": "conv_id % 100", "supplier_email":
        "concat('orders@supplier', conv_id % 100, '.demo')",
        "subject": "concat_ws(' ', 'RFQ', conv_id)", "body_md": "text", "sku": "conv_id",
        "intent": "case when turn <= 2 then 'RFQ' else 'COUNTER' end",
        "sent_by": "'negotiator'", "status": "'SENT'",
    }, "role = 'assistant'"),
    "email_inbox": Binding("conversations", {
        "email_id": "concat_ws('-', 'IN', conv_id, turn)", "thread_id": "conv_id",
        "received_ts": "timestamp_ntz'2024-01-01 00:00:00' + {minutes(turn)}",
        "supplier_id": "conv_id % 100", "supplier_email":
        "concat('orders@supplier', conv_id % 100, '.demo')",
        "subject": "concat_ws(' ', 'Re: RFQ', conv_id)", "body_md": "text", "sku": "conv_id",
        "intent_detected": "case when turn % 2 = 0 then 'QUOTE' when turn = 3 then 'COUNTER' "
                           "when turn = 5 then 'REJECT' else 'OOF' end",
        "extracted_json":
        "concat('{\"unit_price_usd\": ', 10 + conv_id % 7, ', \"pack_size_g\": ', "
        "(conv_id + turn) % 5, ', \"lead_time_days\": ', conv_id % 4, '}')",
        "processed": "case when turn % 3 = 0 then true when turn % 3 = 1 then false end",
    }, "role = 'user'"),
    "quote_replies": Binding("lineitem", {
        "email_id": _LINE_ID, "thread_id": "l_orderkey", "received_ts": "l_shipdate",
        "supplier_id": "l_suppkey", "supplier_email": "concat('s', l_suppkey, '@quotes.demo')",
        "subject": "concat('Re: RFQ ', l_partkey)",
        "body_md":
        "concat(case l_returnflag when 'A' then 'We accept. ' when 'R' then 'Counter offer. ' "
        "else '' end, 'Price: $', {money(l_extendedprice)}, ' per pack of ', "
        "cast(l_quantity as bigint), ' g, lead time ', case when l_orderkey % 90 = 7 then 99999999999 "
        "else 1 + l_orderkey % 30 end, ' days.', "
        "case when l_linestatus = 'F' then ' Certified organic.' else '' end)",
        "sku": "l_partkey", "intent_detected": "cast(null as {text})",
        "extracted_json": "cast(null as {text})", "processed": "l_orderkey % 7 = 3",
    }),
    "supplier_applications": Binding("supplier_nation", {
        "application_id": "s_suppkey", "submitted_ts":
        "timestamp_ntz'2024-01-01 00:00:00' + {minutes(s_suppkey)}",
        "supplier_name": "s_name", "contact_email": "concat('s', s_suppkey, '@apply.demo')",
        "country": "n_name",
        "offered_skus":
        "case s_suppkey % 5 when 0 then '' when 1 then 'lettuce' when 2 then 'lettuce, tulips' "
        "when 3 then 'lettuce, basil, kale' else 'lettuce, tulips, roses, kale' end",
        "organic_cert": "s_suppkey % 2 = 1", "years_in_biz": "cast(s_suppkey % 15 as int)",
        "status": "case when s_suppkey % 10 = 9 then 'SCREENING' else 'NEW' end",
        "score": "cast(null as double)", "agent_notes": "cast(null as {text})",
        "region": "n_regionkey",
    }),
    "agent_runs": Binding("events", {
        "run_id": "event_id", "started_ts": "ts",
        "finished_ts": "ts + {minutes(1)}", "agent_name": "event_type",
        "input_ref": "concat('U', user_id)", "output_ref": "concat('E', event_id)",
        "prompt_tokens": "cast(get_json_object(props, '$.k') as int)",
        "output_tokens": "cast(user_id as int)",
        "status": "case when event_type = 'error' then 'ERROR' else 'OK' end",
    }),
}

_SPARK_TEMPLATES = [
    (r"\{day\((\w+)\)\}", r"unix_date(cast(\1 as date))"),
    (r"\{month\((\w+)\)\}", r"date_format(\1, 'yyyy-MM')"),
    (r"\{minutes\((\w+)\)\}", r"make_dt_interval(0, 0, \1)"),
    (r"\{money\((\w+)\)\}", r"format_number(\1, 2)"),
    (r"\{text\}", "string"),
]
_DUCK_TEMPLATES = [
    (r"\{day\((\w+)\)\}", r"date_diff('day', date '1970-01-01', cast(\1 as date))"),
    (r"\{month\((\w+)\)\}", r"strftime(\1, '%Y-%m')"),
    (r"\{minutes\((\w+)\)\}", r"to_minutes(\1)"),
    (r"\{money\((\w+)\)\}", r"format('{:,.2f}', \1)"),
    (r"\{text\}", "varchar"),
    (r"(\d+\.\d+)D", r"cast(\1 as double)"),
    (r"make_dt_interval\(", "to_days("),
    (r"get_json_object\(", "json_extract_string("),
    (r"timestamp_ntz'", "timestamp '"),
]


def _rewrite(expression: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        expression = re.sub(pattern, replacement, expression)
    return expression


def to_duck(expression: str) -> str:
    return _rewrite(expression, _DUCK_TEMPLATES)


def to_spark(expression: str) -> str:
    return _rewrite(expression, _SPARK_TEMPLATES)


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def source_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its footer is read for the schema only once per process."""
    known = _SCHEMAS.get((folder, name))
    table = batch_source(spark, folder, name, known)
    _SCHEMAS[folder, name] = known or table.schema
    return table


def _source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name == "supplier_nation":
        nation = source_table(spark, folder, "nation")
        return source_table(spark, folder, "supplier").join(
            nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return source_table(spark, folder, name)


def project(df: DataFrame, name: str) -> DataFrame:
    """Apply a binding to its (batch or streaming) source table."""
    binding = BINDINGS[name]
    kept = df.where(to_spark(binding.where)) if binding.where else df
    return kept.select(*[F.expr(to_spark(e)).alias(c) for c, e in binding.columns.items()])


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A feed, dimension or state table bound to the test tables below `folder`."""
    return project(_source(spark, folder, BINDINGS[name].source), name)


def duck_sql(name: str) -> str:
    """The same binding as SQL over the test tables."""
    binding = BINDINGS[name]
    source = binding.source
    if source == "supplier_nation":
        source = "supplier JOIN nation ON s_nationkey = n_nationkey"
    columns = ", ".join(f"{to_duck(e)} AS {c}" for c, e in binding.columns.items())
    where = f" WHERE {to_duck(binding.where)}" if binding.where else ""
    return f"SELECT {columns} FROM {source}{where}"
