"""Compare all (or the named) registered queries: python tests/run_checks.py [folder] [key…]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import __spark_entry__ as entry  # noqa: E402
from harvestline.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    only = set(sys.argv[2:])
    spark = local_session("checks", cores="8")
    con = connect(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for key, query in queries.items():
        if only and key not in only:
            continue
        start = time.time()
        try:
            if key in sqls:
                faults = compare(spark, con, key, query, sqls[key], folder)
            else:
                faults = [] if query(spark, folder).count() else [f"{key}: no rows"]
        except Exception as e:  # noqa: BLE001
            faults = [f"{key}: {type(e).__name__} {str(e)[:1500]}"]
        bad += bool(faults)
        print(f"{'FAIL' if faults else 'ok  '} {key} {time.time() - start:.2f}s"
              f"{'' if key in sqls else ' (rows only)'}", flush=True)
        for f in faults:
            print("   ", f, flush=True)
    print("failed:", bad, "of", len(only or queries))
