"""Declared schemas: event feeds, dimensions, state tables, serving keys."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(),
}


def table(spec: str) -> T.StructType:
    """Build a schema from `name type[!]` items; `!` marks NOT NULL."""
    fields = []
    for item in spec.replace("\n", " ").split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


FEEDS: dict[str, T.StructType] = {
    "inventory_events": table(
        """event_id string!, event_ts timestamp!, sku string!, room_id string!,
        lot_id string, delta_grams double!, on_hand_g double!, reason string"""),
    "supplier_quotes": table(
        """event_id string!, event_ts timestamp!, supplier_id string!, sku string!,
        pack_size_g double!, unit_price_usd double!, min_qty int!, lead_time_days int!,
        valid_until_ts timestamp!, organic boolean, currency string"""),
    "demand_events": table(
        """event_id string!, event_ts timestamp!, sku string!, zone_id string!,
        trays int!, grams_req double!, crop_plan_id string"""),
    "commodity_prices": table(
        """event_id string!, event_ts timestamp!, input_key string!, price_usd double!,
        unit string, currency string, source string"""),
    "purchase_orders": table(
        """event_id string!, event_ts timestamp!, po_number string!, po_item int!,
        event_type string!, supplier_id string!, sku string!, quantity_g double!,
        unit_price_usd double!, net_value_usd double!, currency string,
        delivery_date_ts timestamp, plant string, company_code string,
        purchase_org string"""),
    "goods_receipts": table(
        """event_id string!, event_ts timestamp!, gr_doc_number string!, gr_item int!,
        po_number string!, po_item int!, sku string!, qty_received_g double!,
        room_id string, movement_type string!, batch_id string,
        posting_date_ts timestamp, delivery_note string"""),
    "invoice_documents": table(
        """event_id string!, event_ts timestamp!, invoice_doc_number string!,
        po_number string!, po_item int!, supplier_id string!, invoice_date_ts timestamp,
        posting_date_ts timestamp, quantity_invoiced_g double, unit_price_usd double,
        net_amount_usd double!, tax_amount_usd double, currency string,
        payment_terms string, status string!, variance_usd double"""),
    "iot_sensor_events": table(
        """event_id string!, event_ts timestamp!, room_id string!, sensor_type string!,
        value double!, unit string!"""),
}

DIMENSIONS: dict[str, T.StructType] = {
    "dim_sku": table(
        """sku string!, sku_name string, crop_type string, variety string,
        days_to_harvest int, tray_yield_g double, germination_rate double,
        seed_per_tray_g double, reorder_point_g double, safety_stock_g double,
        target_stock_g double, unit_cost_hint double, organic_preferred boolean"""),
    "dim_supplier": table(
        """supplier_id string!, supplier_name string, country string, tier string,
        on_time_pct double, quality_score double, organic_cert boolean, email string,
        notes string"""),
}

STATE: dict[str, T.StructType] = {
    "email_outbox": table(
        """email_id string!, thread_id string!, created_ts timestamp!, supplier_id string,
        supplier_email string, subject string, body_md string, sku string, intent string,
        sent_by string, status string"""),
    "email_inbox": table(
        """email_id string!, thread_id string!, received_ts timestamp!, supplier_id string,
        supplier_email string, subject string, body_md string, sku string,
        intent_detected string, extracted_json string, processed boolean"""),
    "po_drafts": table(
        """po_id string!, created_ts timestamp!, thread_id string, sku string,
        supplier_id string, packs int, pack_size_g double, total_grams double,
        unit_price_usd double, total_cost_usd double, needed_by date, status string,
        rationale string"""),
    "budget_ledger": table(
        """ledger_id string!, entry_ts timestamp!, period_ym string, category string,
        delta_usd double, balance_usd double, po_id string, note string"""),
    "supplier_applications": table(
        """application_id string!, submitted_ts timestamp!, supplier_name string,
        contact_email string, country string, offered_skus string, organic_cert boolean,
        years_in_biz int, status string, score double, agent_notes string"""),
    "invoice_reconciliations": table(
        """reconciliation_id string!, received_ts timestamp!, po_id string,
        supplier_id string, invoiced_amount_usd double, expected_amount_usd double,
        variance_usd double, variance_pct double, status string, agent_notes string"""),
    "agent_runs": table(
        """run_id string!, started_ts timestamp!, finished_ts timestamp,
        agent_name string, input_ref string, output_ref string, prompt_tokens int,
        output_tokens int, status string, error_msg string"""),
}

# Serving mirror of each gold view: target name, primary key, refresh seconds.
SERVING = {
    "gd_inventory_snapshot": ("inventory_snapshot", ["sku", "room_id"], 30),
    "gd_supplier_leaderboard": ("supplier_leaderboard", ["sku", "supplier_id"], 30),
    "gd_commodity_latest": ("commodity_prices_latest", ["input_key"], 30),
    "gd_demand_1h": ("demand_1h", ["sku", "hour_ts"], 60),
    "gd_recommendations": ("procurement_recommendations", ["recommendation_id"], 30),
    "gd_iot_latest": ("iot_sensor_latest", ["room_id", "sensor_type"], 15),
    "gd_open_po_lines": ("sap_po_lines", ["po_number", "po_item"], 30),
    "gd_invoice_matching": ("sap_invoice_matching", ["invoice_doc_number"], 30),
}

# Columns each serving table must carry.
REQUIRED_COLUMNS = {
    "inventory_snapshot": ["sku", "room_id", "on_hand_g", "last_event_ts",
                           "reorder_point_g", "target_stock_g"],
    "supplier_leaderboard": ["sku", "supplier_id", "supplier_name", "unit_price_usd",
                             "usd_per_gram", "lead_time_days", "score", "rank"],
    "commodity_prices_latest": ["input_key", "price_usd", "unit", "event_ts",
                                "pct_1h", "pct_24h"],
    "demand_1h": ["sku", "hour_ts", "trays", "grams_req"],
    "procurement_recommendations": ["recommendation_id", "created_ts", "sku", "room_id",
                                    "reorder_grams", "recommended_supplier_id",
                                    "total_cost_usd", "decision", "ml_score"],
    "po_drafts": ["po_id", "created_ts", "sku", "supplier_id", "total_cost_usd", "status"],
    "email_outbox": ["email_id", "thread_id", "created_ts", "supplier_id", "subject",
                     "body_md", "intent", "status"],
    "budget_ledger": ["ledger_id", "entry_ts", "period_ym", "category", "delta_usd",
                      "balance_usd"],
    "agent_runs": ["run_id", "started_ts", "agent_name", "status"],
}
