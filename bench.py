"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores and
``BENCH_QUERIES`` a comma-separated choice. Every query runs whole into a sink that
drops its rows; one unmeasured query warms the session up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from ballast.session import build_session

HEADLINE = [
    "confusion_matrix", "metrics_per_seed", "metrics_mean_std", "summary_table", "imbalance_impact",
    "cs_vs_resampling", "stability_boxplot", "cross_dataset", "run_all", "latest_predictions",
    "lending_features", "taiwan_features", "corporate_features", "describe", "median_impute",
    "standard_scale", "stratified_split", "stratified_kfold", "random_under_sample", "class_weights",
    "knn_join", "knn_join_events", "tomek_links", "smote", "smote_tomek", "save_predictions",
    "process_datasets", "train_linear", "train_cost_sensitive", "grid_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "ballast-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
            "spark.driver.memory": "16g",
        },
    )
    from ballast.catalog import QUERIES

    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    QUERIES["default_rate"](spark, sf_dir).collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
