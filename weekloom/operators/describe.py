"""What a series, a table or a group of series looks like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.dates import weeks_between
from weekloom.functions.numeric import positive, ratio
from weekloom.operators.clean import sale_weeks
from weekloom.spec import DEFAULT, SeriesSpec


def sale_intervals(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Weeks with sales, the sale week before, and the weeks between the two (first sale of a series left out)."""
    sales = sale_weeks(df, spec).withColumn("prev_sale_week", F.lag(spec.time).over(spec.in_time()))
    return sales.filter(F.col("prev_sale_week").isNotNull()).select(
        *spec.keys,
        spec.time,
        "prev_sale_week",
        weeks_between(F.col(spec.time), F.col("prev_sale_week")).alias("interval_weeks"),
    )


def mean_interval(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Average demand interval of the series with at least two sale weeks.

    The intervals of a series add up to last minus first sale week, so no window is needed.
    """
    return (
        sale_weeks(df, spec)
        .groupBy(*spec.keys)
        .agg(F.min(spec.time).alias("__first"), F.max(spec.time).alias("__last"), F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > 1)
        .select(*spec.keys, (weeks_between(F.col("__last"), F.col("__first")) / (F.col("__n") - 1)).alias("adi_weeks"))
    )


def volume_aggregates(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """All aggregates of a series in one pass over its rows."""
    v = F.col(spec.value)
    sold = positive(v)
    sale_week = F.when(v > 0, F.col(spec.time))
    return df.groupBy(*spec.keys).agg(
        F.sum(v).alias("total_liters"),
        F.avg(v).alias("mean_liters"),
        F.median(v).alias("median_liters"),
        F.max(v).alias("max_liters"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_liters"),
        F.count(F.lit(1)).alias("num_weeks"),
        F.count(sold).alias("nonzero_weeks_count"),
        F.avg(F.when(v == 0, F.lit(1.0).cast("double")).otherwise(F.lit(0.0).cast("double"))).alias("zero_ratio"),
        F.avg(sold).alias("mean_nonzero_liters"),
        F.median(sold).alias("median_nonzero_liters"),
        F.coalesce(F.stddev_samp(sold), F.lit(0.0)).alias("std_nonzero_liters"),
        F.avg(F.when(F.col(spec.promo) == 1, v)).alias("mean_liters_promo"),
        F.avg(F.when(F.col(spec.promo) == 0, v)).alias("mean_liters_no_promo"),
        F.min(sale_week).alias("__first_sale"),
        F.max(sale_week).alias("__last_sale"),
    )


def series_features(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Descriptors of each series: size, intermittency, variability, reaction to promotions.

    One shuffle by series. A series without two sale weeks has its number of weeks as demand interval; one
    without sales has 0 for the nonzero statistics; one that cannot show a promotion effect has a lift of 1.
    """
    a = volume_aggregates(df, spec)
    sales = F.col("nonzero_weeks_count")
    interval = F.when(sales > 1, weeks_between(F.col("__last_sale"), F.col("__first_sale")) / (sales - 1))
    variation = F.pow(ratio(F.col("std_nonzero_liters"), F.col("mean_nonzero_liters")), F.lit(2.0))
    lift = ratio(F.col("mean_liters_promo"), F.col("mean_liters_no_promo"))
    return a.select(
        *spec.keys,
        "total_liters",
        "mean_liters",
        "median_liters",
        "max_liters",
        "std_liters",
        "num_weeks",
        "nonzero_weeks_count",
        "zero_ratio",
        F.coalesce("mean_nonzero_liters", F.lit(0.0)).alias("mean_nonzero_liters"),
        F.coalesce("median_nonzero_liters", F.lit(0.0)).alias("median_nonzero_liters"),
        "std_nonzero_liters",
        F.coalesce(variation, F.lit(0.0)).alias("cv_squared"),
        F.coalesce(interval, F.col("num_weeks").cast("double")).alias("adi"),
        F.coalesce(lift, F.lit(1.0)).alias("promo_lift"),
    )


def dataset_profile(df: DataFrame, spec: SeriesSpec = DEFAULT, approximate: bool = False) -> DataFrame:
    """One row of counts, ranges and totals; a figure is left out if its column is not in the table.

    ``approximate`` counts distinct values by sketches, which spares the shuffle of the values.
    """
    have = set(df.columns)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    out = [F.count(F.lit(1)).alias("row_count")]
    for column, name in ((spec.keys[0], "unique_sites"), (spec.keys[-1], "unique_items"), ("promo_id", "unique_promos")):
        if column in have:
            out.append(distinct(F.col(column)).alias(name))
    date = next((c for c in ("calday", spec.time) if c in have), None)
    if date:
        out += [F.min(date).alias("first_date"), F.max(date).alias("last_date")]
    if spec.promo in have:
        promo = F.count_if(F.col(spec.promo) == 1)
        out += [
            promo.alias("promo_rows"),
            (F.count(F.lit(1)) - promo).alias("no_promo_rows"),
            F.coalesce(ratio(promo, F.count(F.lit(1))) * 100, F.lit(0.0)).alias("promo_pct"),
        ]
    if spec.value in have:
        out += [F.sum(spec.value).alias("total_volume"), F.avg(spec.value).alias("avg_volume")]
    return df.agg(*out)


def table_schema(df: DataFrame) -> DataFrame:
    """Column names and types as rows."""
    return df.sparkSession.createDataFrame(df.dtypes, "column_name string, column_type string")


def preview(df: DataFrame, n: int = 50) -> DataFrame:
    """Some first rows, for looking at a table."""
    return df.limit(n)


def label_distribution(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Rows per label, with their share; the window runs over one row per label."""
    counts = df.groupBy(spec.label).agg(F.count(F.lit(1)).alias("row_count"))
    total = F.sum("row_count").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("pct", F.col("row_count") / total * 100)
