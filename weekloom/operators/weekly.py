"""From single sales to gap-free weekly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.dates import monday
from weekloom.operators.clean import in_period
from weekloom.operators.lookup import spread_join
from weekloom.settings import FLAGGED_PERIOD, MIN_WEEKS_GOLD
from weekloom.spec import DEFAULT, SeriesSpec


def with_retailer(df: DataFrame, retailers: DataFrame) -> DataFrame:
    """The rows of a table of retailers' doings with the site and type of their retailer.

    The join carries no hint: Spark broadcasts the retailers if their files are small enough, and else splits
    hot retailers at run time (adaptive skew join).
    """
    d = retailers.select(F.col("detallista").alias("__retailer"), "establecimiento", F.col("type").alias("tipo"))
    return df.join(d, F.col("detallista").cast("string") == F.col("__retailer")).drop("__retailer")


def silver_rows(sales: DataFrame, retailers: DataFrame | None = None) -> DataFrame:
    """Single sales with the site and type of their retailer; without ``retailers`` the sales must carry both."""
    joined = sales if retailers is None else with_retailer(sales, retailers)
    return joined.select("establecimiento", "material", "calday", "promo_id", "tipo", "volume_ap", "cantidad_umb")


def silver_rollup(sales: DataFrame, retailers: DataFrame | None = None) -> DataFrame:
    """Sales per site, item, day, promotion and type; the sums are partly built before the only shuffle."""
    return (
        silver_rows(sales, retailers)
        .groupBy("establecimiento", "material", "calday", "promo_id", "tipo")
        .agg(F.sum("volume_ap").alias("volume_ap"), F.sum("cantidad_umb").alias("cantidad_umb"))
    )


def weekly_rollup(
    df: DataFrame, spec: SeriesSpec = DEFAULT, date: str = "calday", volume: str = "volume_ap"
) -> DataFrame:
    """One row per series and week (Monday): volume added up, flags by maximum."""
    return df.groupBy(*spec.keys, monday(F.col(date)).alias(spec.time)).agg(
        F.sum(volume).cast("double").alias(spec.value),
        F.max(spec.promo).alias(spec.promo),
        F.max(spec.period).alias(spec.period),
    )


def fill_gaps(df: DataFrame, period: tuple[str, str] = FLAGGED_PERIOD, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Every week between the first and the last of a series; added weeks have volume and promotion 0.

    Each row is repeated up to the row after it, so the table is shuffled by series once and never joined.
    """
    following = F.lead(spec.time).over(spec.in_time())
    weeks = F.sequence(
        F.col(spec.time),
        F.coalesce(F.date_sub(F.col("__following"), 7), F.col(spec.time)),
        F.expr("interval 7 days"),
    )
    filled = df.withColumn("__following", following).withColumn("__week", F.explode(weeks))
    real = F.col("__week") == F.col(spec.time)
    values = {
        spec.time: F.col("__week"),
        spec.value: F.when(real, F.col(spec.value)).otherwise(F.lit(0.0)),
        spec.promo: F.when(real, F.col(spec.promo)).otherwise(F.lit(0)),
        spec.period: F.when(real, F.col(spec.period)).otherwise(in_period(F.col("__week"), period)),
    }
    return filled.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])


def min_weeks(df: DataFrame, weeks: int = MIN_WEEKS_GOLD, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Keep series with at least that many rows."""
    counted = df.withColumn("__weeks", F.count(F.lit(1)).over(spec.by_series()))
    return counted.filter(F.col("__weeks") >= weeks).drop("__weeks")


def sort_by_volume(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Largest series first, in time order inside each."""
    total = F.sum(spec.value).over(spec.by_series())
    return (
        df.withColumn("__total", total).orderBy(F.col("__total").desc(), *spec.keys, spec.time).drop("__total")
    )


def distinct_series(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return df.select(*spec.keys).distinct()


def distinct_items(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return df.select(spec.keys[-1]).distinct()


def distinct_labels(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return df.select(spec.label).filter(F.col(spec.label).isNotNull()).distinct()


def top_series(df: DataFrame, n: int, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """The ``n`` series with the largest total volume; equal totals in key order."""
    return (
        df.groupBy(*spec.keys)
        .agg(F.sum(spec.value).alias("total_volume"))
        .orderBy(F.col("total_volume").desc(), *spec.keys)
        .limit(n)
    )


def recent_rows(df: DataFrame, rows: int, spec: SeriesSpec = DEFAULT, group: list[str] | None = None) -> DataFrame:
    """Per group the rows from the date of its ``rows``-th latest row on; rows of that date are all kept.

    Only the counts per (group, date) are ordered: as many as there are dates.
    """
    group = [spec.label] if group is None else group
    per_date = df.groupBy(*group, spec.time).agg(F.count(F.lit(1)).alias("__n"))
    latest_first = Window.partitionBy(*group).orderBy(F.col(spec.time).desc())
    cutoffs = (
        per_date.withColumn("__seen", F.sum("__n").over(latest_first))
        .groupBy(*group)
        .agg(
            F.coalesce(F.max(F.when(F.col("__seen") >= rows, F.col(spec.time))), F.min(spec.time)).alias("__cutoff")
        )
    )
    kept = spread_join(df, cutoffs, group, "inner")
    return kept.filter(F.col(spec.time) >= F.col("__cutoff")).drop("__cutoff").select(*df.columns)
