"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import re
import time

from creditloom.session import build_session

HEADLINE = [
    "default_label_rows", "price_change_lookup", "nearest_rate_lag", "loss_label_rows", "woe_table", "information_value",
    "population_stability", "scorecard", "discrimination", "split_metric_rows", "calibration_error", "kaplan_meier",
    "concordance_index", "cumulative_default_by_age", "path_ecl_summary", "peak_weighted_ecl", "loan_loss_quantile", "servicing_scan",
    "cox_coefficients", "temperature_fit", "logistic_coefficients", "boosted_metrics", "loss_model_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    from creditloom.catalog.registry import QUERIES

    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    # one small run to load classes and start Python workers, not timed
    QUERIES["discrimination"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else sf_dir,
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
