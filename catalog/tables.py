"""Layer tables of the checks, each computed once per session and folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators import cluster, describe, features, forecast
from weekloom.operators.scale import Scaler
from weekloom.plans import layers
from weekloom.session import stage
from weekloom.settings import SERIES_FEATURES
from weekloom.sources import bronze
from weekloom.spec import DEFAULT

# Reference points for the nearest-centroid checks, the same number in every scaled feature.
CENTRES = [-0.8, -0.1, 0.4, 1.2]

# Fixed value: large enough to move the coefficients of a ridge over all rows.
RIDGE_PENALTY = 1e5

_made: dict[tuple, object] = {}


def once(spark: SparkSession, folder: str, name: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


# Added before rounding: exact halves in the last digit, which two engines may round apart, become decided.
NUDGE = "1e-9"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, without negative zero."""
    nudge, zero = F.lit(float(NUDGE)), F.lit(0.0)
    return df.select(
        *[(F.round(F.col(c) + nudge, digits) + zero).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def silver(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark,
        folder,
        "silver",
        lambda: stage(layers.silver(bronze.sales(spark, folder, bronze.retailers(spark, folder)))),
    )


def flagged(spark: SparkSession, folder: str) -> DataFrame:
    from weekloom.operators.clean import exclude_types, flag_period, flag_promo

    df = exclude_types(silver(spark, folder), bronze.EXCLUDED_SEGMENTS)
    return flag_period(flag_promo(df), bronze.PERIOD)


def weekly(spark: SparkSession, folder: str) -> DataFrame:
    from weekloom.operators.weekly import weekly_rollup

    return weekly_rollup(flagged(spark, folder))


def gold_plan(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """From the given tables to the weekly gold table, nothing stored on the way."""
    return layers.weekly_gold_from_sales(
        bronze.sales(spark, folder, bronze.retailers(spark, folder)),
        types=bronze.EXCLUDED_SEGMENTS,
        period=bronze.PERIOD,
        ordered=ordered,
    )


def gold(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "gold", lambda: stage(gold_plan(spark, folder)))


def series_features(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "series", lambda: stage(describe.series_features(gold(spark, folder))))


def scaler(spark: SparkSession, folder: str) -> Scaler:
    return once(spark, folder, "scaler", lambda: Scaler.fit(series_features(spark, folder), SERIES_FEATURES))


def scaled(spark: SparkSession, folder: str) -> DataFrame:
    df = series_features(spark, folder).select(*DEFAULT.keys, *SERIES_FEATURES)
    return scaler(spark, folder).transform(df)


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest of the fixed centres, so that SQL can reproduce the labels."""
    names = list(SERIES_FEATURES)
    df = cluster.assign_nearest(scaled(spark, folder), names, [[c] * len(names) for c in CENTRES])
    return df.select(*DEFAULT.keys, "cluster_label")


def clustered(spark: SparkSession, folder: str) -> DataFrame:
    return once(
        spark, folder, "clustered", lambda: stage(cluster.attach_labels(gold(spark, folder), labels(spark, folder)))
    )


def model_table(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows, one folder per cluster."""
    return once(
        spark,
        folder,
        "model",
        lambda: stage(features.row_features(clustered(spark, folder)), partition_by=["cluster_label"]),
    )


def backtest(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "backtest", lambda: stage(forecast.naive_backtest(gold(spark, folder))))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    df = cluster.attach_labels(backtest(spark, folder), labels(spark, folder))
    return df.select(
        *DEFAULT.keys,
        F.col("ds").alias("week"),
        F.col("y").alias("actual_volume"),
        F.col("yhat").alias("predicted_volume"),
        "cluster_label",
    )
