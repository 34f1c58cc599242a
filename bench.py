"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from trackloom.plans import catalog

HEADLINE = [
    "scan_filter_select", "filter_tuple_in", "min_max_all_columns", "group_min_max", "target_summary", "robust_statistics", "update_from_join", "union_all_time_order",
    "asof_interpolate", "asof_compare_status", "gap_sessions", "reference_periods_ui", "detection_rollup", "correct_rate", "position_rms", "linear_fit", "extra_data", "dubious_targets",
    "sector_containment", "hash_best_match", "candidate_range_join", "overlap_pairs", "histogram_range", "grid2d_stats", "top_n_rows", "retention_cut",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.local.dir", folder).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "sum of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
