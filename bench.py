"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.plans.session import local_session  # noqa: E402
from tidemark.queries import registered  # noqa: E402

HEADLINE = (
    "resample_hourly", "resample_minutely", "resample_panel", "fill_gaps", "preprocess", "lags", "trailing_stats",
    "centred_full", "centred_partial_panel", "feature_build", "chronological_split", "multi_step_windows", "running_total",
    "describe", "correlations", "histogram", "box_by_weekday", "grouped_quantiles", "daily_shipments", "model_comparison",
    "zscore_detector", "rolling_detector", "severity_minutely", "severity_panel", "top_alerts", "combined_anomalies",
    "last_rows_panel", "classical_decomposition", "stl_decomposition", "isolation_forest", "multi_step_direct", "walk_forward",
    "random_forest", "look_back_linear", "sarima_forecast", "tree_shapley", "stream_monitor", "stream_adaptive", "panel_kpi_cards", "panel_severity_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    table = registered()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the engine before the clock runs
    seconds = {}
    for name in HEADLINE:
        query = table[name][0]
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
