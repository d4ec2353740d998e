"""Serving mirrors brought up to date by change sets, one query each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from harvestline import schemas
from harvestline.checks import gold
from harvestline.checks.registry import CHECKS, ROUNDED, Tables, query
from harvestline.functions import timing
from harvestline.plans import silver
from harvestline.session import scratch_path
from harvestline.sources import bindings
from harvestline.sources.changes import Mirror

# The earlier snapshot is what the view showed at these times.
EARLIER = {"events": datetime(2024, 1, 20), "lineitem": datetime(1997, 1, 1)}


class _Earlier:
    """The same tables with every feed as it was at an earlier time."""

    def __init__(self, t: Tables) -> None:
        self.spark, self.folder, self.views, self._now = t.spark, t.folder, {}, t

    def __getattr__(self, name: str):
        table = getattr(self._now, name)
        if name not in silver.FEEDS:
            return table
        until = EARLIER[bindings.BINDINGS[name].source]
        return table.where(F.col("event_ts") < timing.instant_like(table, "event_ts", until))


BUILDS = {
    "gd_inventory_snapshot": gold.gd_inventory_snapshot, "gd_supplier_leaderboard": gold.gd_supplier_leaderboard,
    "gd_commodity_latest": gold.gd_commodity_latest, "gd_demand_1h": gold.gd_demand_1h,
    "gd_recommendations": gold.gd_recommendations, "gd_iot_latest": gold.gd_iot_latest,
    "gd_open_po_lines": gold.gd_open_po_lines, "gd_invoice_matching": gold.gd_invoice_matching,
}


def mirrored(t: Tables, view: str):
    """Sync the earlier snapshot, then the present one, and read the target."""
    table, keys, _ = schemas.SERVING[view]
    mirror = Mirror(t.spark, scratch_path(t.spark, f"mirror-{table}"), keys)
    mirror.sync(BUILDS[view](_Earlier(t)))
    mirror.sync(BUILDS[view](t))
    return mirror.read()


for _view, (_table, _, _) in schemas.SERVING.items():
    query(f"mirror_{_table}", CHECKS[_view], ROUNDED[_view])(lambda t, view=_view: mirrored(t, view))
