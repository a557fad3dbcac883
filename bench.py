"""Headline queries, one JSON line: seconds per query and the size figures.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tlake.session import build  # noqa: E402
from workload.queries import REGISTRY  # noqa: E402

HEADLINE = [
    "top_metrics_by_service", "recent_log_count", "trace_time_ranges", "table_extent", "exact_distinct_services",
    "otlp_flatten_logs", "container_path_extract", "container_log_merge", "fix_time_rules", "split_no_session",
    "enrich_pods", "otlp_spans", "spans_default_view", "logs_with_spans", "span_tree", "service_edges", "red_metrics",
    "log_volume", "attr_profile", "gauge_series", "counter_rate", "histogram_quantile", "exp_histogram_quantile",
    "lake_logs_round_trip", "hot_cold_scan", "traces_with_errors", "lake_ingest_report", "stream_logs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})

    def run(name: str) -> float:
        t = time.perf_counter()
        # All columns of all rows are computed, none is sent to the driver.
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    run(HEADLINE[0])  # start the JVM's work once
    seconds = {}
    for name in HEADLINE:
        first = run(name)
        seconds[name] = round(min(first, run(name)), 3)
    sizes = REGISTRY["json_vs_columnar"](spark, sf_dir).first().asDict()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "json_to_compressed": sizes["json_ratio"],
                "plain_columns_to_compressed": sizes["plain_ratio"], "log_rows": sizes["rows"],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
