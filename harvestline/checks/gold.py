"""The nine gold views."""

from __future__ import annotations

from harvestline.checks.registry import CHECKS, ROUNDED, VIEWS, Tables, query, shared
from harvestline.plans import gold, silver
from harvestline.session import cut_lineage
from harvestline.sources.bindings import AS_OF_EVENTS, AS_OF_QUOTES, BANDS, BINDINGS, CROPS

# The rule sets in the checking SQL's own words. The SQL of every gold view reads deduplicated
# feeds; in Spark only sums need that, newest rows are the same with copies.
SQL_RULES = {
    "inventory_events": "event_ts IS NOT NULL AND sku IS NOT NULL AND room_id IS NOT NULL "
                        "AND on_hand_g >= 0",
    "supplier_quotes": "unit_price_usd > 0 AND pack_size_g > 0 AND lead_time_days >= 0",
    "demand_events": "trays > 0 AND grams_req > 0",
    "commodity_prices": "price_usd > 0 AND input_key IS NOT NULL",
    "purchase_orders": "quantity_g > 0 AND unit_price_usd > 0 AND supplier_id IS NOT NULL",
    "goods_receipts": "po_number IS NOT NULL AND sku IS NOT NULL",
    "invoice_documents": "po_number IS NOT NULL AND supplier_id IS NOT NULL",
    "iot_sensor_events": "room_id IS NOT NULL AND sensor_type IS NOT NULL AND value IS NOT NULL",
}
for _feed, _rule in SQL_RULES.items():
    _columns = ", ".join(f"{c} NULLS FIRST" for c in BINDINGS[_feed].columns if c != "event_id")
    VIEWS[f"sv_{_feed}"] = (
        f"SELECT * FROM {_feed} WHERE {_rule} "
        f"QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY {_columns}) = 1")

_NEWEST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY {} DESC, {} DESC) = 1"


def newest(keys: str, ts: str = "event_ts", tie: str = "event_id") -> str:
    return _NEWEST.format(keys, ts, tie)


VIEWS["gd_inventory_snapshot"] = f"""
    SELECT i.sku, i.room_id, i.on_hand_g, i.event_ts AS last_event_ts, d.sku_name, d.crop_type,
           d.reorder_point_g, d.safety_stock_g, d.target_stock_g, d.organic_preferred
    FROM (SELECT * FROM sv_inventory_events {newest('sku, room_id')}) i
    LEFT JOIN dim_sku d ON d.sku = i.sku"""

VIEWS["gd_commodity_latest"] = """
    SELECT input_key, price_usd, unit, event_ts,
           CASE WHEN p1 IS NOT NULL THEN (price_usd - p1) / p1 END AS pct_1h,
           CASE WHEN p24 IS NOT NULL THEN (price_usd - p24) / p24 END AS pct_24h
    FROM (SELECT input_key, arg_max(price_usd, (event_ts, event_id)) AS price_usd,
                 arg_max(unit, (event_ts, event_id)) AS unit, max(event_ts) AS event_ts,
                 arg_max(price_usd, (event_ts, event_id))
                   FILTER (event_ts <= timestamp '2024-01-30 23:00:00') AS p1,
                 arg_max(price_usd, (event_ts, event_id))
                   FILTER (event_ts <= timestamp '2024-01-30 00:00:00') AS p24
          FROM sv_commodity_prices GROUP BY input_key)"""

VIEWS["gd_demand_1h"] = """
    SELECT sku, date_trunc('hour', event_ts) AS hour_ts, cast(sum(trays) AS bigint) AS trays,
           sum(grams_req) AS grams_req
    FROM sv_demand_events GROUP BY ALL"""

VIEWS["gd_supplier_quotes_current"] = f"""
    SELECT *, unit_price_usd / pack_size_g AS usd_per_gram FROM sv_supplier_quotes
    WHERE valid_until_ts > timestamp '2001-01-01 00:00:00' {newest('sku, supplier_id')}"""

VIEWS["po_latest"] = f"SELECT * FROM sv_purchase_orders {newest('po_number, po_item')}"
VIEWS["receipt_totals"] = """
    SELECT po_number, po_item, sum(qty_received_g) AS got FROM sv_goods_receipts GROUP BY ALL"""

VIEWS["gd_open_po_lines"] = """
    SELECT p.po_number, p.po_item, p.event_type, p.supplier_id, s.supplier_name,
           s.tier AS supplier_tier, p.sku, p.quantity_g, p.unit_price_usd, p.net_value_usd,
           p.delivery_date_ts, coalesce(r.got, 0) AS qty_received_g,
           p.quantity_g - coalesce(r.got, 0) AS qty_outstanding_g,
           CASE WHEN p.event_type = 'CANCELLED' THEN 'CANCELLED'
                WHEN coalesce(r.got, 0) >= p.quantity_g * 0.99 THEN 'FULLY_RECEIVED'
                WHEN coalesce(r.got, 0) > 0 THEN 'PARTIALLY_RECEIVED' ELSE 'OPEN' END AS po_status,
           p.event_ts
    FROM po_latest p LEFT JOIN receipt_totals r USING (po_number, po_item)
    LEFT JOIN dim_supplier s ON s.supplier_id = p.supplier_id"""

VIEWS["sensor_bands"] = """
    SELECT * FROM (VALUES ('click'), ('view'), ('purchase'), ('signup')) v(sensor_type)
    CROSS JOIN (SELECT cast(20 AS double) AS alert_min, cast(300 AS double) AS alert_max,
                       cast(50 AS double) AS warn_min, cast(200 AS double) AS warn_max,
                       cast(0 AS double) AS disp_min, cast(400 AS double) AS disp_max)"""

VIEWS["gd_iot_latest"] = f"""
    SELECT room_id, sensor_type, value, unit, event_ts, alert_min, alert_max, warn_min,
           warn_max, disp_min, disp_max,
           CASE WHEN value < alert_min OR value > alert_max THEN 'ALERT'
                WHEN value < warn_min OR value > warn_max THEN 'CAUTION'
                ELSE 'NOMINAL' END AS status
    FROM (SELECT * FROM sv_iot_sensor_events {newest('room_id, sensor_type')})
    LEFT JOIN sensor_bands USING (sensor_type)"""

VIEWS["gd_invoice_matching"] = f"""
    SELECT i.*, p.net_value_usd AS po_net_value_usd, p.quantity_g AS po_quantity_g,
           p.event_type AS po_event_type, p.sku, coalesce(r.got, 0) AS gr_qty_g,
           CASE WHEN p.net_value_usd IS NULL THEN 'NO_PO'
                WHEN coalesce(r.got, 0) = 0 THEN 'PENDING_GR'
                WHEN abs(i.variance_usd) <= p.net_value_usd * 0.02 THEN 'MATCHED'
                ELSE 'VARIANCE' END AS match_status
    FROM (SELECT * FROM sv_invoice_documents {newest('invoice_doc_number')}) i
    LEFT JOIN po_latest p USING (po_number, po_item)
    LEFT JOIN receipt_totals r USING (po_number, po_item)"""

VIEWS["crop_inputs"] = """
    SELECT * FROM (VALUES ('ECONOMY', 'click'), ('MEDIUM', 'view'), ('SMALL', 'purchase'),
                          ('LARGE', 'signup'), ('STANDARD', 'error')) v(crop_type, input_key)"""
VIEWS["sku_trend"] = """
    SELECT d.sku, c.pct_24h AS input_pct_24h
    FROM dim_sku d JOIN crop_inputs USING (crop_type) JOIN gd_commodity_latest c USING (input_key)"""
VIEWS["supplier_features"] = """
    SELECT q.*, s.supplier_name, coalesce(s.on_time_pct, 0.85) AS on_time_pct,
           coalesce(s.quality_score, 0.85) AS quality_score,
           CASE WHEN s.organic_cert THEN 1.0 ELSE 0.0 END AS organic_cert_int,
           coalesce(d.n, 0) AS demand_1h_trays, coalesce(t.input_pct_24h, 0) AS input_pct_24h
    FROM gd_supplier_quotes_current q
    LEFT JOIN dim_supplier s USING (supplier_id)
    LEFT JOIN (SELECT sku, sum(trays) AS n FROM gd_demand_1h GROUP BY sku) d USING (sku)
    LEFT JOIN sku_trend t USING (sku)"""
VIEWS["scored_offers"] = """
    SELECT *, exp(-1.2 * greatest(price_norm - 0.9, 0)) AS price_term,
           exp(-0.35 * (log10(pack_size_g) - 2) ** 2) AS pack_term,
           exp(-lead_time_days / 15.0) AS lead_term,
           0.6 * on_time_pct + 0.4 * quality_score AS reliability_term,
           tanh(demand_1h_trays / 40.0) AS urgency_term,
           0.5 + 0.5 * tanh(input_pct_24h * 20) AS trend_term,
           0.5 + 0.5 * organic_cert_int AS organic_term,
           least(greatest(0.3 * price_term + 0.1 * pack_term + 0.15 * lead_term
             + 0.2 * reliability_term + 0.1 * urgency_term + 0.1 * trend_term
             + 0.05 * organic_term, 0), 1) AS score
    FROM (SELECT *, usd_per_gram / (SELECT avg(usd_per_gram) FROM supplier_features)
                    AS price_norm FROM supplier_features)"""
VIEWS["gd_supplier_leaderboard"] = """
    SELECT sku, supplier_id, supplier_name, pack_size_g, unit_price_usd, usd_per_gram,
           lead_time_days, min_qty, organic, score,
           cast(row_number() OVER (PARTITION BY sku ORDER BY score DESC, supplier_id)
                AS integer) AS rank, event_ts AS quote_ts
    FROM scored_offers"""
VIEWS["low_offers"] = """
    SELECT *, greatest(i.target_stock_g - i.on_hand_g, 0) AS reorder_grams,
           cast(ceil(greatest(i.target_stock_g - i.on_hand_g, 0) / b.pack_size_g) AS integer)
             AS packs
    FROM gd_inventory_snapshot i LEFT JOIN sku_trend t USING (sku)
    LEFT JOIN (SELECT * FROM gd_supplier_leaderboard WHERE rank = 1) b USING (sku)
    WHERE i.on_hand_g <= i.reorder_point_g"""
VIEWS["gd_recommendations"] = """
    SELECT concat_ws('-', sku, room_id, '20240131000000') AS recommendation_id,
           timestamp '2024-01-31 00:00:00' AS created_ts, sku, room_id, reorder_grams, packs,
           supplier_id AS recommended_supplier_id, supplier_name AS recommended_supplier_name,
           pack_size_g, unit_price_usd, packs * unit_price_usd AS total_cost_usd,
           lead_time_days AS expected_lead_days, score AS ml_score, input_pct_24h,
           CASE WHEN input_pct_24h > 0.01 OR on_hand_g < reorder_point_g * 0.5 OR score > 0.85
                THEN 'BUY_NOW'
                WHEN input_pct_24h < -0.01 AND on_hand_g > reorder_point_g * 0.8 THEN 'WAIT'
                ELSE 'REVIEW' END AS decision,
           concat_ws(' · ', 'on_hand_g=' || format('{:,.0f}', on_hand_g),
                     'reorder_g=' || format('{:,.0f}', reorder_point_g),
                     'input24h=' || format('{:,.2f}', input_pct_24h * 100) || '%',
                     'ml_score=' || format('{:,.3f}', score)) AS rationale
    FROM low_offers"""


# what the net receipts of a line need
RECEIPT = ["po_number", "po_item", "qty_received_g"]


@shared
def snapshot(t: Tables):
    return gold.inventory_snapshot(
        silver.validated("inventory_events", t.inventory_events), t.dim_sku)


@shared
def prices(t: Tables):
    return gold.commodity_latest(
        silver.validated("commodity_prices", t.commodity_prices), AS_OF_EVENTS)


@shared
def stored_prices(t: Tables):
    """The price view as a table: one row per input, read by two later views."""
    return cut_lineage(prices(t), "commodity-latest")


@shared
def demand(t: Tables):
    return gold.demand_1h(silver.deduplicated(
        "demand_events", t.demand_events, ["event_ts", "sku", "trays", "grams_req"]))


@shared
def quotes(t: Tables):
    return gold.supplier_quotes_current(
        silver.validated("supplier_quotes", t.supplier_quotes), AS_OF_QUOTES)


@shared
def po_lines(t: Tables):
    return gold.open_po_lines(
        silver.validated("purchase_orders", t.purchase_orders),
        silver.deduplicated("goods_receipts", t.goods_receipts, RECEIPT), t.dim_supplier)


@shared
def sensors(t: Tables):
    return gold.iot_latest(silver.validated("iot_sensor_events", t.iot_sensor_events), BANDS)


@shared
def matches(t: Tables):
    return gold.invoice_matching(
        silver.validated("invoice_documents", t.invoice_documents),
        silver.validated("purchase_orders", t.purchase_orders),
        silver.deduplicated("goods_receipts", t.goods_receipts, RECEIPT))


@shared
def trend(t: Tables):
    return gold.sku_trend(stored_prices(t), t.dim_sku, CROPS)


@shared
def features(t: Tables):
    return gold.supplier_features(
        quotes(t), t.dim_supplier, demand(t), stored_prices(t), t.dim_sku, CROPS)


@shared
def stored_features(t: Tables):
    return gold.stored_features(features(t))


def leaderboard(t: Tables, top: int | None = None):
    return gold.supplier_leaderboard(stored_features(t), top=top)


@shared
def recommended(t: Tables):
    return gold.recommendations(snapshot(t), leaderboard(t, top=1), trend(t), AS_OF_EVENTS)


@query("gd_inventory_snapshot", "SELECT * FROM gd_inventory_snapshot")
def gd_inventory_snapshot(t: Tables):
    return snapshot(t)


@query("gd_commodity_latest", """
    SELECT input_key, price_usd, unit, event_ts, R(pct_1h) AS pct_1h, R(pct_24h) AS pct_24h
    FROM gd_commodity_latest""")
def gd_commodity_latest(t: Tables):
    return prices(t)


@query("gd_demand_1h", "SELECT sku, hour_ts, trays, R(grams_req) AS grams_req FROM gd_demand_1h",
       round_to=3)
def gd_demand_1h(t: Tables):
    return demand(t)


@query("gd_supplier_quotes_current", """
    SELECT * REPLACE (R(usd_per_gram) AS usd_per_gram) FROM gd_supplier_quotes_current""", round_to=8)
def gd_supplier_quotes_current(t: Tables):
    return quotes(t)


@query("gd_open_po_lines", """
    SELECT * REPLACE (R(unit_price_usd) AS unit_price_usd, R(qty_received_g) AS qty_received_g,
                      R(qty_outstanding_g) AS qty_outstanding_g) FROM gd_open_po_lines""", round_to=8)
def gd_open_po_lines(t: Tables):
    return po_lines(t).drop("event_id")


@query("gd_iot_latest", "SELECT * FROM gd_iot_latest")
def gd_iot_latest(t: Tables):
    return sensors(t)


@query("gd_invoice_matching", """
    SELECT * REPLACE (R(net_amount_usd) AS net_amount_usd, R(variance_usd) AS variance_usd,
                      R(gr_qty_g) AS gr_qty_g) FROM gd_invoice_matching""")
def gd_invoice_matching(t: Tables):
    return matches(t)


@query("gd_supplier_leaderboard", """
    SELECT * REPLACE (R(usd_per_gram) AS usd_per_gram, R(score) AS score)
    FROM gd_supplier_leaderboard""", round_to=8)
def gd_supplier_leaderboard(t: Tables):
    return leaderboard(t)


@query("gd_recommendations", """
    SELECT * REPLACE (R(reorder_grams) AS reorder_grams, R(total_cost_usd) AS total_cost_usd,
                      R(ml_score) AS ml_score, R(input_pct_24h) AS input_pct_24h)
    FROM gd_recommendations""")
def gd_recommendations(t: Tables):
    return recommended(t)


class _Twice:
    """The same tables with every feed delivered twice."""

    def __init__(self, t: Tables) -> None:
        self.spark, self.folder, self.views, self._once = t.spark, t.folder, {}, t

    def __getattr__(self, name: str):
        table = getattr(self._once, name)
        return table.union(table) if name in silver.FEEDS else table


# Delivered twice, a feed gives the same views as delivered once.
for _key, _build in (("gd_inventory_snapshot", gd_inventory_snapshot), ("gd_commodity_latest", gd_commodity_latest),
                     ("gd_demand_1h", gd_demand_1h), ("gd_supplier_quotes_current", gd_supplier_quotes_current),
                     ("gd_open_po_lines", gd_open_po_lines), ("gd_iot_latest", gd_iot_latest),
                     ("gd_invoice_matching", gd_invoice_matching)):
    query(f"{_key}_twice", CHECKS[_key], ROUNDED[_key])(
        lambda t, build=_build: build(_Twice(t)))
