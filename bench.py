"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from checks.queries import QUERIES
from faultline.session import build_session

HEADLINE = [
    "fct_revenue", "payments_derive", "wq_topk_revenue", "wq_sum_by_customer", "wq_above_average",
    "dq_unique", "table_checksum", "golden_capture", "column_checksum", "parity_row_diff",
    "downstream_reach", "column_reach", "assess_changes", "recommend_strategy",
    "table_refs", "star_exposure", "rename_patch", "verification_report",
    "usage_attribution", "query_fingerprint", "usage_stats",
    "snapshot_history_diff", "drift_stream", "trace_by_tool",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        # Local files are few and small: cut them finer than the default 4 MB per task.
        "spark.sql.files.openCostInBytes": "1m",
    })
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["wq_status_counts"](spark, sf_dir).count()  # start the executor threads
    times = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale.group(1)) if scale else None, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
