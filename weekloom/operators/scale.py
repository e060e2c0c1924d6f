"""Standardised features and exact medians."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.lookup import number_levels, prefix_totals


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations of some columns: one pair of numbers per column."""

    stats: dict[str, tuple[float, float]]

    @staticmethod
    def fit(df: DataFrame, columns: Iterable[str]) -> Scaler:
        columns = list(columns)
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).first()
        return Scaler({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        """(x - mean) / deviation; a constant column is only centred."""
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items() if c in df.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in self.stats.items() if c in df.columns})

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, float(m), float(s)) for c, (m, s) in self.stats.items()]
        table = spark.createDataFrame(rows, "feature string, mean double, deviation double")
        table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scaler:
        rows = spark.read.parquet(path).collect()
        return Scaler({r["feature"]: (r["mean"], r["deviation"]) for r in rows})


def exact_medians(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Median of each column over all rows, as (feature, median).

    A median aggregate would gather all values of a column in one task. Here equal values are counted first, the
    counts are ordered by a distributed running total, and only the one or two middle values are read off.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    counts = (
        df.select(pairs.alias("p"))
        .select("p.*")
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = prefix_totals(counts, ["feature"], ["value"], {"n": F.col("n")}, number_levels("value"))
    low, high = F.floor((F.col("n_total") - 1) / 2), F.floor(F.col("n_total") / 2)

    def holds(place):
        return (F.col("n_before") <= place) & (place < F.col("n_before") + F.col("n"))

    return (
        placed.filter(holds(low) | holds(high))
        .groupBy("feature")
        .agg(((F.min("value") + F.max("value")) / 2).alias("median"))
    )


def median_values(df: DataFrame, columns: Iterable[str], approximate: bool = False) -> dict[str, float]:
    """Medians of the columns with missing values, null or NaN (the others need none); 0 for a column without values.

    Exact medians at every size shuffle the distinct values; ``approximate`` uses a sketch of bounded size and no shuffle of
    values instead. Both leave out missing values.
    """
    values = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    if not values:
        return {}
    facts = df.agg(*[F.count_if(v.isNull()).alias(c) for c, v in values.items()]).first()
    needed = [c for c in values if facts[c]]
    if not needed:
        return {}
    if approximate:
        row = df.agg(*[F.percentile_approx(values[c], 0.5, 10_000).alias(c) for c in needed]).first()
        found = {c: row[c] for c in needed if row[c] is not None}
    else:
        found = {r["feature"]: r["median"] for r in exact_medians(df, needed).collect()}
    return {c: found.get(c, 0.0) for c in needed}


def fold_medians(
    df: DataFrame, columns: Iterable[str], folds: int, group: list[str], fold: str = "fold"
) -> DataFrame:
    """(group, feature, fold, median): the median of each column over the rows before each expanding fold.

    The training rows of fold f are those with ``fold`` < f, and f = ``folds`` takes all of them, so they are prefixes: one
    table counts every distinct value per prefix, one ordering of it finds the middle values of all prefixes, all groups
    and all columns. Null and NaN are left out; a prefix without values has no row. Building the plan starts no job.
    """
    columns = list(columns)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    )
    values = df.select(*group, F.col(fold).alias("__fold"), pairs.alias("p")).select(*group, "__fold", "p.*")
    values = values.filter(F.col("value").isNotNull() & ~F.isnan("value") & F.col("__fold").isNotNull())
    # 0.0 and -0.0 are one value.
    values = values.withColumn("value", F.col("value") + F.lit(0.0))
    prefixes = [f"n{f}" for f in range(folds + 1)]
    counts = values.groupBy(*group, "feature", "value").agg(
        *[F.count_if(F.col("__fold") < f).alias(n) for f, n in enumerate(prefixes)]
    )
    placed = prefix_totals(counts, [*group, "feature"], ["value"], {n: F.col(n) for n in prefixes}, number_levels("value"))

    def middle(n: str) -> Column:
        before, total, rows = F.col(f"{n}_before"), F.col(f"{n}_total"), F.col(n)
        low, high = F.floor((total - 1) / 2), F.floor(total / 2)
        held = ((before <= low) & (low < before + rows)) | ((before <= high) & (high < before + rows))
        value = F.when((rows > 0) & held, F.col("value"))
        return (F.min(value) + F.max(value)) / 2

    found = placed.groupBy(*group, "feature").agg(F.array(*[middle(n) for n in prefixes]).alias("medians"))
    return found.select(*group, "feature", F.posexplode("medians").alias("fold", "median")).filter("median IS NOT NULL")
