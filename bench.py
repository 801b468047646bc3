"""Time the headline queries once warm: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores; BENCH_QUERIES may name other queries, comma-separated.
"""

from __future__ import annotations

import json
import os
import sys
import time

from stockloom.plans.queries import QUERIES
from stockloom.session import local_session

HEADLINE = [
    "mov1_movement_analysis", "sel1_sellout", "alr1_movement_alerts", "sea2_seasonal_index", "sea3_smart_cv", "yoy1_comparison",
    "lfl1_like_for_like", "abc1_abc_xyz", "smr1_rolling_sales", "smr7_movement_summary", "mon2_to_mon10_monthly_analysis", "dsh2_inventory_supply",
    "mh1_must_have", "osi4_outlet_counts", "sug1_suggestions", "rot4_transfers_out", "rb3_rebalance", "po1_po_lines", "exp3_expiry_windows",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "stockloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, names[0], folder)  # start the JVM's code paths once
    times = {}
    for name in names:
        try:
            times[name] = round(run(spark, name, folder), 3)
        except Exception as e:  # noqa: BLE001  one failing query must not hide the other timings
            print(f"{name}: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
    sf = os.path.basename(folder.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
