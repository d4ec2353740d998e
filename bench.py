"""Time the headline queries on local cores and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default all) the
cores, BENCH_RUNS (default 2) how often each query runs; the best run counts. Every query
is computed in full over its whole tables and its result is discarded by a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harvestline import checks  # noqa: E402
from harvestline.checks.registry import PLAIN  # noqa: E402
from harvestline.session import local_session, scratch_ends_here  # noqa: E402

HEADLINE = [
    # feeds
    "silver_inventory", "silver_quotes", "silver_po", "silver_invoices", "rule_metrics",
    # gold views
    "gd_inventory_snapshot", "gd_commodity_latest", "gd_demand_1h",
    "gd_supplier_quotes_current", "gd_open_po_lines", "gd_iot_latest", "gd_invoice_matching",
    "gd_supplier_leaderboard", "gd_recommendations",
    # scoring
    "procurement_score", "vectorised_score_udf",
    # single operators
    "latest_per_key", "asof_each_row", "pct_vs_baseline", "receipts_sum", "three_way_match",
    "top_n_per_group", "greedy_budget",
    # workflow and serving
    "budget_gate", "reconcile", "inbound_extract", "onboard_score", "kpi_summary",
    "thread_rollup", "q_po_lines",
    # streams
    "stream_silver", "stream_tumbling", "stream_latest", "stream_budget",
]


def run(spark, key: str, folder: str) -> float:
    start = time.perf_counter()
    with scratch_ends_here(spark):
        PLAIN[key](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    checks.load_all()
    spark = local_session("bench", cores=cores, memory="16g",
                          shuffle_partitions=int(cores) if cores.isdigit() else os.cpu_count())
    only = sys.argv[1:] or HEADLINE
    seconds = {key: round(min(run(spark, key, folder) for _ in range(runs)), 3) for key in only}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
