"""Result tables of many series: what is done, what is new, which trial was best."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.operators.lookup import lookup_join, spread_join
from weekloom.settings import ADDITIVE_GRID
from weekloom.spec import DEFAULT, SeriesSpec


def series_id(df: DataFrame, name: str = "series_id", spec: SeriesSpec = DEFAULT) -> DataFrame:
    return df.withColumn(name, F.concat_ws("_", *[F.col(k) for k in spec.keys]))


def split_series_id(df: DataFrame, name: str = "series_id", spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Site and item of a series id; the item may itself contain the separator."""
    parts = F.split(F.col(name), "_", 2)
    return df.withColumns({k: F.get(parts, i) for i, k in enumerate(spec.keys)})


def remaining(df: DataFrame, done: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Rows of the series that are not in the table of finished ones."""
    return df.join(done.select(*spec.keys).distinct(), spec.key_list, "left_anti")


def remaining_labels(df: DataFrame, done: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Rows of the clusters that are not in the table of finished ones."""
    finished = done.select(spec.label).distinct().withColumn("__done", F.lit(True))
    return lookup_join(df, finished, [spec.label]).filter(F.col("__done").isNull()).drop("__done")


def carried_over(results: DataFrame, wanted: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Earlier results of the wanted series."""
    return results.join(wanted.select(*spec.keys).distinct(), spec.key_list, "left_semi")


def merge_results(old: DataFrame, new: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Old and new rows together; a series that is in both keeps its new row."""
    both = old.withColumn("__round", F.lit(0)).unionByName(new.withColumn("__round", F.lit(1)), True)
    rest = [c for c in both.columns if c not in spec.keys]
    newest = both.groupBy(*spec.keys).agg(F.max_by(F.struct(*rest), F.col("__round")).alias("r"))
    return newest.select(*spec.keys, "r.*").drop("__round")


def param_grid(spark: SparkSession, grid: Mapping[str, Iterable] = ADDITIVE_GRID) -> DataFrame:
    """All combinations of the parameter values, numbered. The size is that of the grid, not of any data."""
    names = list(grid)
    df = spark.range(1).select()
    for name in names:
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in grid[name]])))
    return df.select(*names, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*names)).alias("param_id"))


def best_params(trials: DataFrame, error: str, group: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """Parameters with the least error per group; of equal errors the first in parameter order."""
    columns = list(columns)
    order = F.struct(F.col(error).isNull(), F.col(error), *columns)
    best = trials.groupBy(*group).agg(F.min(order).alias("b"))
    return best.select(*group, *[F.col(f"b.{c}").alias(c) for c in columns], F.col(f"b.{error}").alias(error))


def fill_out_of_fold(
    df: DataFrame, column: str = "oof_pred", how: str = "mean", group: list[str] | None = None, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Rows before the first validation fold have no prediction: give them the group's mean, or drop them."""
    group = [spec.label] if group is None else group
    if how == "drop":
        return df.filter(F.col(column).isNotNull())
    means = df.groupBy(*group).agg(F.avg(column).alias("__mean"))
    return spread_join(df, means, group).withColumn(column, F.coalesce(column, "__mean")).select(*df.columns)


def union_all(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def future_frame(df: DataFrame, weeks: int, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Dates of each series and the given number of weeks after its end, with all flags 0."""
    flags = [c for c in (spec.promo, spec.period) if c in df.columns]
    last = F.max(spec.time).over(spec.by_series())
    dated = df.select(*spec.keys, spec.time, (F.col(spec.time) == last).alias("__is_last"))
    ahead = F.sequence(F.col(spec.time), F.date_add(spec.time, 7 * weeks), F.expr("interval 7 days"))
    dates = F.when(F.col("__is_last"), ahead).otherwise(F.array(spec.time))
    return dated.select(*spec.keys, F.explode(dates).alias("ds"), *[F.lit(0).alias(c) for c in flags])
