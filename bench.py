"""Time the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 1 timed run after one warm-up on the small tables).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import collect  # noqa: E402
from revcast.session import local_session  # noqa: E402

HEADLINE = {
    "model_table": "jn11_model_table",
    "daily_rollup": "jn12_daily_rollup",
    "lags_and_rolling": "fe03_rolling",
    "regressor_features": "fe06_regressor_features",
    "apply_fixes": "cl09_apply_fixes",
    "quality_checks": "qa01_quality_checks",
    "cost_validation": "qa10_cost_validation",
    "baseline_backtest": "ev07_fold_summary",
    "weighted_blend": "ev11_weighted_blend",
    "forecast_run": "pp10_forecast_run",
    "series_summary": "ba02_series_summary",
    "driver_impact": "ba09_driver_impact",
    "budget_moves": "ba12_dimension_budget",
    "whale_watch": "ba13_whale_watch",
    "cohort_roas_table": "co08_roas_table",
    "spending_decomposition": "sp07_decomposition",
    "user_days": "sp02_user_days",
    "dimension_months": "in01_dimension_months",
    "gradient_boosting": "mo13_gradient_boosting",
    "model_table_events": "jn11_model_table_events",
    "exponential_smoothing": "mo07_exponential_smoothing",
    "elastic_net": "mo12_elasticnet",
    "classifier_layer": "in05_lead_quality",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, memory="16g")
    queries, _ = collect()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    queries["jn12_daily_rollup"](spark, small if os.path.isdir(small) else sf_dir).count()
    times = {}
    for label, name in HEADLINE.items():
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[label] = round(statistics.median(taken), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
