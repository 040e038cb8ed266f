"""Seconds per headline query. Prints one JSON line.

BENCH_SF_DIR  tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default: all)
BENCH_RUNS    timed runs per query, of which the best counts (default 2; the first one also warms up the JVM)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.registry import QUERIES  # noqa: E402
from tablewright.session import build_session  # noqa: E402

HEADLINES = [
    "column_counts_orders",
    "numeric_profile_lineitem",
    "text_profile_documents",
    "distribution_lineitem",
    "quality_assessment_orders",
    "duplicate_count_lineitem",
    "exact_dedupe_part",
    "near_dedupe_documents",
    "fill_missing_orders",
    "cap_outliers_orders",
    "cleaned_orders",
    "pii_scan_documents",
    "mask_contacts",
    "mask_spans_documents",
    "correlations_lineitem",
    "trends_lineitem",
    "column_mapping_orders",
    "insert_statements_orders",
    "csv_round_trip_orders",
    "lineitem_by_status",
    "forest_models_orders",
    "clusters_customer",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(f"{name:32s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
