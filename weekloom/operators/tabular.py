"""Generic steps for any table: fills, date parts, frequent categories, windows of days."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CATEGORIES = 50
TIME_WINDOWS = [7, 14, 30, 90]


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """The column as a date, with its year, month, day and day of the week (Monday is 0)."""
    date = F.to_date(column)
    return df.withColumns(
        {
            column: date,
            f"{column}_year": F.year(date),
            f"{column}_month": F.month(date),
            f"{column}_day": F.dayofmonth(date),
            f"{column}_dayofweek": F.weekday(date),
        }
    )


def top_categories(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list[str]:
    """The most frequent values; equal counts in value order. At most ``limit`` values reach the driver."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    rows = counts.orderBy(F.col("count").desc(), column).limit(limit).collect()
    return [r[column] for r in rows]


def one_hot_top(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> DataFrame:
    """0/1 columns of the most frequent values and one for all others (missing values too)."""
    top = top_categories(df, column, limit)
    value = F.coalesce(F.col(column).isin(top), F.lit(False))
    kind = F.when(value, F.col(column).cast("string")).otherwise(F.lit("other"))
    return df.withColumns(
        {f"{column}_{v}": (kind == F.lit(str(v))).cast("int") for v in [*top, "other"]}
    )


def day_windows(
    df: DataFrame, keys: Iterable[str], date: str, value: str, days: Iterable[int] = tuple(TIME_WINDOWS)
) -> DataFrame:
    """Sum, mean, deviation, least and greatest value of the last n days, per key and day.

    Rows are put together per (key, day) first: the window then runs over days, however many rows a key has.
    """
    keys = list(keys)
    x = F.col(value).cast("double")
    daily = df.groupBy(*keys, F.col(date).cast("date").alias(date)).agg(
        F.count(x).alias("__n"),
        F.sum(x).alias("__sum"),
        F.var_pop(x).alias("__var"),
        F.min(x).alias("__min"),
        F.max(x).alias("__max"),
    )
    # Squares around the mean of the key, so that large values do not cancel out.
    centre = F.sum("__sum").over(Window.partitionBy(*keys)) / F.sum("__n").over(Window.partitionBy(*keys))
    mean = F.col("__sum") / F.col("__n")
    daily = daily.withColumn("__day", F.unix_date(date)).withColumn("__centre", centre)
    daily = daily.withColumn("__shift", F.col("__sum") - F.col("__n") * F.col("__centre")).withColumn(
        "__squares", F.col("__n") * (F.col("__var") + (mean - F.col("__centre")) * (mean - F.col("__centre")))
    )
    out = {}
    for n in days:
        w = Window.partitionBy(*keys).orderBy("__day").rangeBetween(-(n - 1), 0)
        count, total = F.sum("__n").over(w), F.sum("__sum").over(w)
        shift, squares = F.sum("__shift").over(w), F.sum("__squares").over(w)
        variance = (squares - shift * shift / count) / F.nullif(count - 1, F.lit(0))
        out |= {
            f"sum_{n}d": total,
            f"mean_{n}d": total / count,
            f"std_{n}d": F.sqrt(F.when(variance < 0, F.lit(0.0)).otherwise(variance)),
            f"min_{n}d": F.min("__min").over(w),
            f"max_{n}d": F.max("__max").over(w),
        }
    return daily.withColumns(out).select(*keys, date, *out)
