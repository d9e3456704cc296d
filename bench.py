"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and run to its end (every row computed, nothing kept) and timed; the first
query pays for a warm-up that is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cityflux.plans.scratch import clear
from cityflux.registry import QUERIES
from cityflux.session import local_session

HEADLINE = [
    "scan_range", "raw_enriched", "parse_payloads", "hourly_aggregation", "daily_aggregation", "peak_hours_panel",
    "peak_hours", "recent_aggregates", "upsert_aggregates", "combined_view", "latest_readings", "dashboard_frame",
    "map_points", "dedupe_first", "clean_data", "cleaning_counters", "iqr_filter_prices", "impute_interpolate",
    "impute_mean", "engineer_features", "rolling_means_items", "scale_standard", "time_split", "sequences",
    "preprocess_full", "summary_statistics", "location_stats", "hourly_pattern", "correlation_matrix",
    "anomalies_iqr", "key_findings", "regression_metrics", "classification_report", "roc_auc_ovr",
    "residual_histogram", "forecast_fit", "forecast", "stream_hourly", "stream_5min",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "8g"))
    only = sys.argv[1:] or HEADLINE
    QUERIES["hourly_aggregation"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f} {name}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    clear(spark)
    spark.stop()


if __name__ == "__main__":
    main()
