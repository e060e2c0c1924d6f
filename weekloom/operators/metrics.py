"""Accuracy of predictions, from single series up to the total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.numeric import ratio
from weekloom.operators.lookup import fix, lookup_join
from weekloom.spec import DEFAULT, SeriesSpec


def absolute_error(y: Column, yhat: Column) -> Column:
    return F.abs(y - yhat)


def percentage_error(y: Column, yhat: Column) -> Column:
    """Error as a share of the actual value, NULL for an actual value of 0."""
    return F.when(y != 0, F.abs((y - yhat) / y))


def root_mean_square(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def global_metrics(forecasts: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Accuracy of the sum over all series per date, as one row.

    The number of series is counted next to the dates and both are put together by one last aggregate.
    """
    no_number = F.lit(None).cast("double")
    dates = forecasts.groupBy("ds").agg(F.sum("y").alias("y"), F.sum("yhat").alias("yhat"))
    dates = dates.select("y", "yhat", F.lit(0).alias("series"), F.lit(1).alias("dates"))
    series = forecasts.select(*spec.keys).distinct()
    series = series.select(
        no_number.alias("y"), no_number.alias("yhat"), F.lit(1).alias("series"), F.lit(0).alias("dates")
    )
    y, yhat = F.col("y"), F.col("yhat")
    off = ratio(F.abs(F.sum(y) - F.sum(yhat)), F.sum(y))
    return dates.unionByName(series).agg(
        root_mean_square(y - yhat).alias("global_rmse"),
        F.avg(absolute_error(y, yhat)).alias("global_mae"),
        (F.avg(percentage_error(y, yhat)) * 100).alias("global_mape_pct"),
        F.sum("series").cast("bigint").alias("included_series"),
        F.sum("dates").cast("bigint").alias("total_periods"),
        F.sum(y).alias("total_actual_volume"),
        F.sum(yhat).alias("total_predicted_volume"),
        ((F.lit(1.0) - off) * 100).alias("volume_accuracy"),
    )


NEAR_ZERO = 1e-9


def cluster_metrics(
    predictions: DataFrame,
    actual: str = "actual_volume",
    predicted: str = "predicted_volume",
    spec: SeriesSpec = DEFAULT,
    group: list[str] | None = None,
) -> DataFrame:
    """MAE, RMSE, MAPE (a share; NULL as soon as one actual value is 0) and R2 per group."""
    group = [spec.label] if group is None else group
    y, p = F.col(actual), F.col(predicted)
    squares = F.sum((y - p) * (y - p))
    spread = F.var_pop(y) * F.count(y)
    has_zero = F.bool_or(F.abs(y) <= NEAR_ZERO)
    return predictions.groupBy(*group).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(absolute_error(y, p)).alias("mae"),
        root_mean_square(y - p).alias("rmse"),
        F.when(~has_zero, F.avg(percentage_error(y, p))).alias("mape"),
        F.when(spread > 0, F.lit(1.0) - squares / spread)
        .when(squares == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
        .alias("r2"),
        F.avg(y).alias("mean_actual"),
        F.avg(p).alias("mean_predicted"),
    )


def naive_scale(
    train: DataFrame, boundary: str = "per_series", spec: SeriesSpec = DEFAULT, group: list[str] | None = None
) -> DataFrame:
    """Mean step between neighbouring training rows of a group, and the number of rows.

    ``boundary="per_series"`` takes steps inside the series only. ``boundary="continuous"`` also takes the step
    from the last row of a series to the first row of the next one, in key order.
    """
    group = [spec.label] if group is None else group
    w = Window.partitionBy(*group, *spec.keys).orderBy(spec.time)
    steps = train.withColumn("__step", F.abs(F.col(spec.value) - F.lag(spec.value).over(w)))
    per_group = steps.groupBy(*group).agg(
        F.sum("__step").alias("__sum"), F.count("__step").alias("__steps"), F.count(F.lit(1)).alias("train_rows")
    )
    if boundary == "continuous":
        borders = _border_steps(train, spec, group)
        borders = borders.select(*[F.col(c).alias(f"__b_{c}") for c in group], "__border_sum", "__border_steps")
        same = [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in group]  # a NULL group meets its own borders
        per_group = per_group.join(borders, same, "left").select(
            *group,
            # Without a step inside a series the sum is NULL although border steps may exist.
            (F.coalesce("__sum", F.lit(0.0)) + F.coalesce("__border_sum", F.lit(0.0))).alias("__sum"),
            (F.col("__steps") + F.coalesce("__border_steps", F.lit(0))).alias("__steps"),
            "train_rows",
        )
    elif boundary != "per_series":
        raise ValueError(f"unknown boundary {boundary}")
    return per_group.select(*group, ratio(F.col("__sum"), F.col("__steps")).alias("naive_mae"), "train_rows")


def _border_steps(train: DataFrame, spec: SeriesSpec, group: list[str]) -> DataFrame:
    """Steps between neighbouring series. Series are range-partitioned; only block ends cross partitions."""
    ends = train.groupBy(*group, *spec.keys).agg(
        F.min_by(spec.value, spec.time).alias("__open"), F.max_by(spec.value, spec.time).alias("__close")
    )
    order = [*group, *spec.keys]
    ends = fix(ends.repartitionByRange(*order).withColumn("__block", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "__block").orderBy(*spec.keys)
    inner = ends.withColumn("__step", F.abs(F.col("__open") - F.lag("__close").over(inside)))
    inner = inner.groupBy(*group).agg(F.sum("__step").alias("__s"), F.count("__step").alias("__n"))
    key = F.struct(*spec.keys)
    blocks = ends.groupBy(*group, "__block").agg(
        F.min_by("__open", key).alias("__open"), F.max_by("__close", key).alias("__close")
    )
    across = Window.partitionBy(*group).orderBy("__block")
    outer = blocks.withColumn("__step", F.abs(F.col("__open") - F.lag("__close").over(across)))
    outer = outer.groupBy(*group).agg(F.sum("__step").alias("__s"), F.count("__step").alias("__n"))
    return (
        inner.unionByName(outer)
        .groupBy(*group)
        .agg(F.coalesce(F.sum("__s"), F.lit(0.0)).alias("__border_sum"), F.sum("__n").alias("__border_steps"))
    )


def mase(
    train: DataFrame,
    predictions: DataFrame,
    boundary: str = "per_series",
    actual: str = "actual_volume",
    predicted: str = "predicted_volume",
    spec: SeriesSpec = DEFAULT,
    group: list[str] | None = None,
) -> DataFrame:
    """Test MAE over the mean training step; without steps NULL, with zero steps 0 or infinite."""
    group = [spec.label] if group is None else group
    scale = naive_scale(train, boundary, spec, group)
    error = predictions.groupBy(*group).agg(
        F.avg(absolute_error(F.col(actual), F.col(predicted))).alias("test_mae")
    )
    flat = F.col("naive_mae") < NEAR_ZERO
    return error.join(scale, group, "left").select(
        *group,
        "test_mae",
        "naive_mae",
        F.when((F.col("train_rows") < 2) | F.col("naive_mae").isNull(), F.lit(None).cast("double"))
        .when(flat & (F.col("test_mae") > NEAR_ZERO), F.lit(float("inf")))
        .when(flat, F.lit(0.0))
        .otherwise(ratio(F.col("test_mae"), F.col("naive_mae")))
        .alias("mase"),
    )


def horizon_metrics(backtest: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Errors per series and distance from the cutoff; coverage is the share inside the interval."""
    y, yhat = F.col("y"), F.col("yhat")
    inside = y.between(F.col("yhat_lower"), F.col("yhat_upper"))
    return backtest.groupBy(*spec.keys, "horizon_weeks").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(y != 0).alias("nonzero_rows"),
        F.avg((y - yhat) * (y - yhat)).alias("mse"),
        root_mean_square(y - yhat).alias("rmse"),
        F.avg(absolute_error(y, yhat)).alias("mae"),
        (F.avg(percentage_error(y, yhat)) * 100).alias("mape_pct"),
        F.avg(F.coalesce(inside, F.lit(False)).cast("double")).alias("coverage"),
    )


def smooth_horizons(horizons: DataFrame, share: float = 0.1, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Horizon metrics averaged over the nearest earlier horizons, until they hold a share of the series' rows.

    Each value is the mean of the last ``share`` of all rows in the order of their horizon; of the earliest horizon
    that is reached only the missing part counts. Horizons with too few rows before them are left out. The arrays
    hold one entry per horizon.
    """
    in_order = spec.by_series().orderBy("horizon_weeks")
    names = ["mse", "mae", "coverage"]
    placed = horizons.withColumns(
        {
            "__upto": F.sum("row_count").over(in_order),
            "__need": F.greatest(F.lit(1), F.floor(F.sum("row_count").over(spec.by_series()) * F.lit(share))),
        }
    )
    placed = placed.withColumn("__bins", F.collect_list(F.struct("__upto", "row_count", *names)).over(in_order))
    start = F.col("__upto") - F.col("__need")

    def mean(name):
        def add(total, b):
            rows = b["__upto"] - F.greatest(b["__upto"] - b["row_count"], start)
            return total + F.greatest(rows, F.lit(0)) * b[name]

        return F.aggregate("__bins", F.lit(0.0).cast("double"), add) / F.col("__need")

    return (
        placed.filter(start >= 0)
        .withColumns({name: mean(name) for name in names})
        .withColumn("rmse", F.sqrt("mse"))
        .select(*horizons.columns)
    )


def series_metrics(backtest: DataFrame, smooth: float | None = None, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Mean over the horizons; the percentage error is that of all rows with a nonzero actual value.

    With ``smooth`` the horizons are first smoothed over that share of the rows.
    """
    horizons = horizon_metrics(backtest, spec)
    scores = _over_horizons(horizons, spec)
    if smooth is None:
        return scores
    smoothed = _over_horizons(smooth_horizons(horizons, smooth, spec), spec)
    names = ["mse", "rmse", "mae", "coverage"]
    return scores.drop(*names).join(smoothed.select(*spec.keys, *names), spec.key_list).select(*scores.columns)


def _over_horizons(horizons: DataFrame, spec: SeriesSpec) -> DataFrame:
    weighted = F.sum(F.col("mape_pct") * F.col("nonzero_rows"))
    return (
        horizons.groupBy(*spec.keys)
        .agg(
            F.avg("mse").alias("mse"),
            F.avg("rmse").alias("rmse"),
            F.avg("mae").alias("mae"),
            ratio(weighted, F.sum("nonzero_rows")).alias("mape_pct"),
            F.avg("coverage").alias("coverage"),
            F.sum("row_count").alias("data_points"),
        )
    )


def metric_summary(results: DataFrame) -> DataFrame:
    """Average, least and greatest of each metric over the series that have one, and how many do."""
    metrics = [("mape_pct", "mape"), ("rmse", "rmse"), ("mae", "mae")]
    has_any = F.coalesce(*[F.col(c) for c, _ in metrics]).isNotNull()
    out = []
    for column, name in metrics:
        out += [
            F.avg(column).alias(f"avg_{name}"),
            F.min(column).alias(f"min_{name}"),
            F.max(column).alias(f"max_{name}"),
        ]
    return results.agg(
        *out, F.count_if(has_any).alias("successful_models"), F.count(F.lit(1)).alias("total_models")
    )


def rank_results(results: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Best series first: by MAPE where known, then those with RMSE, then those with MAE."""
    tier = (
        F.when(F.col("mape_pct").isNotNull(), 0)
        .when(F.col("rmse").isNotNull(), 1)
        .when(F.col("mae").isNotNull(), 2)
        .otherwise(3)
    )
    return results.withColumn("rank_tier", tier).orderBy(
        "rank_tier", F.coalesce("mape_pct", "rmse", "mae"), *spec.keys
    )


def tuning_effect(evaluated: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Per series the errors of two forecasts ``default_yhat`` and ``tuned_yhat`` and the gain in percent.

    The percentage error looks at rows with an actual value above zero.
    """
    y = F.col("y")
    out = []
    for name in ("default", "tuned"):
        p = F.col(f"{name}_yhat")
        out += [
            root_mean_square(y - p).alias(f"{name}_rmse"),
            F.avg(absolute_error(y, p)).alias(f"{name}_mae"),
            (F.avg(F.when(y > 0, F.abs((y - p) / y))) * 100).alias(f"{name}_mape_pct"),
        ]
    per_series = evaluated.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("test_points"), *out)
    gain = [
        F.when(
            F.col(f"default_{m}") > 0,
            (F.col(f"default_{m}") - F.col(f"tuned_{m}")) / F.col(f"default_{m}") * 100,
        ).alias(f"{m.removesuffix('_pct')}_gain_pct")
        for m in ("rmse", "mae", "mape_pct")
    ]
    return per_series.select("*", *gain)


def tuning_summary(effect: DataFrame) -> DataFrame:
    return effect.agg(
        F.avg("rmse_gain_pct").alias("avg_rmse_gain_pct"),
        F.avg("mae_gain_pct").alias("avg_mae_gain_pct"),
        F.avg("mape_gain_pct").alias("avg_mape_gain_pct"),
        F.count(F.lit(1)).alias("series_tested"),
        F.count_if(F.col("rmse_gain_pct") > 0).alias("series_improved"),
    )


def mean_over_groups(metrics: DataFrame, columns) -> DataFrame:
    """Plain mean of each metric over the groups."""
    return metrics.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def attach_mase(metrics: DataFrame, scaled: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Both tables hold one row per group."""
    return lookup_join(metrics, scaled.select(spec.label, "mase"), [spec.label])
