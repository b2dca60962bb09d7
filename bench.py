"""Headline queries after one warm-up run, median of the rest, and fits and scans of all series once, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattframe.plans.catalog import load_queries  # noqa: E402
from wattframe.session import build_session  # noqa: E402

HEADLINE = [
    "canonical_features", "dedup_first", "gap_detect", "fill_bounded", "quality_report", "value_profile", "calendar_features", "solar_position", "interp_join",
    "asof_available", "asof_history", "past_rolling", "demand_feature_frame", "hourly_lags", "low_run", "spike_thresholds", "asset_limits", "baseline_eval",
    "classify_deviation", "cause_category", "dispatch_eval", "rank_plans", "grid_snapshot", "zone_totals", "dispatch_text_audit", "resource_check",
]
# Run once, after the others, and not part of the sum: with their fits these take minutes.
ONCE = ["renewable_status", "stream_ingest"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.files.openCostInBytes": "1m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_queries()
    names = sys.argv[1:] or [*HEADLINE, *ONCE]
    seconds = {}
    for name in names:
        taken = []
        for _ in range(1 if name in ONCE else runs + 1):
            started = time.perf_counter()
            queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_seconds", "value": round(sum(x for n, x in seconds.items() if n not in ONCE), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
