"""Time the headline queries on whole tables and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Each query runs ``ROUNDS`` times (the long ones
once) after the stored layers have been made; the best time counts. Results go to the noop sink, so that all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from catalog import tables as t
from weekloom.operators import cluster, describe, features, forecast, metrics, split, tabular, weekly
from weekloom.plans import layers
from weekloom.session import local_session
from weekloom.sources import bronze

ROUNDS = 4
ONCE = {"additive_backtest", "additive_grid_search", "kmeans_sweep"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    gold, clustered = t.gold(spark, folder), t.clustered(spark, folder)

    cases = {
        "silver_rollup": lambda: layers.silver(bronze.sales(spark, folder), bronze.retailers(spark, folder)),
        "weekly_gold": lambda: t.gold_plan(spark, folder, ordered=True),
        "dataset_profile": lambda: describe.dataset_profile(gold),
        "top_n_series": lambda: weekly.top_series(gold, 20),
        "series_features": lambda: describe.series_features(gold),
        "lag_features": lambda: features.lag_features(gold),
        "rolling_without_medians": lambda: features.rolling_features(gold).select(
            *gold.columns,
            *[
                f"volume_roll_{f}_{w}w"
                for w in (4, 8, 12, 52)
                for f in ("mean", "std", "count_nonzero", "mean_nonzero", "std_nonzero")
            ],
        ),
        "rolling_with_medians": lambda: features.rolling_features(gold),
        "rolling_52w": lambda: features.rolling_features(gold, [52]),
        "row_features": lambda: features.row_features(clustered),
        "next_week_features": lambda: features.next_week_features(clustered),
        "positional_split": lambda: split.positional_split(clustered),
        "cv_folds": lambda: split.cv_folds(clustered),
        "naive_backtest": lambda: metrics.series_metrics(forecast.naive_backtest(gold)),
        "day_windows": lambda: tabular.day_windows(
            t.silver(spark, folder), ["establecimiento", "material"], "calday", "volume_ap"
        ),
        "additive_forecast": lambda: forecast.forecast(gold),
        "additive_backtest": lambda: forecast.backtest(gold),
        "additive_grid_search": lambda: forecast.grid_search(gold),
        "kmeans_sweep": lambda: cluster.sweep(t.scaled(spark, folder)),
    }
    seconds = {}
    for name, make in cases.items():
        times = []
        for _ in range(1 if name in ONCE else ROUNDS):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "cores": spark.sparkContext.defaultParallelism,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
