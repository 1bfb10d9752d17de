"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is planned, run and fully materialised once after one shared warm-up scan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from catalog import QUERIES

HEADLINE = [
    "season_of_date", "rate_stats", "canonicalize_logs", "rolling_mean", "form_features", "rolling_std", "rest_days",
    "trailing_slope", "career_cumulative", "carry_fill", "robust_z", "sequence_windows", "performance_training",
    "latest_per_key", "top_n_per_group", "dedup_keep", "enrich_left", "join_by_name_key", "enrich_with_fallback",
    "lag_join_inner", "fill_median", "group_median_fill", "scale_sequences", "season_summary", "season_stats",
    "recent_form", "consistency_stats", "target_summary", "trend_signals", "consistency_signals", "range_signals",
    "evaluate_ranges", "role_features", "clean_role", "salary_training", "lagged_salary", "horizon_targets",
    "long_term_training", "classification_metrics", "trend_threshold_grid", "blend_weight_grid",
    "volatility_multiplier_grid", "missing_summary", "duplicate_keys", "validate_training", "correlation_summary",
    "redundant_pairs", "mutual_information", "find_replacements_batch", "cosine_similar", "fit_ridge",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("formline-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    for table in ("lineitem", "events", "orders", "supplier"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.format("noop").mode("overwrite").save()
    names, times = sys.argv[1:] or HEADLINE, {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "formline_total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
