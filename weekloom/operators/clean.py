"""Filters, flags, fills and casts of sales tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weekloom.functions.numeric import is_bad
from weekloom.settings import DROPPED_COLUMNS, EXCLUDED_TYPES, FLAGGED_PERIOD, TRAINING_RANGE
from weekloom.spec import DEFAULT, SeriesSpec


def exclude_types(df: DataFrame, types: Iterable[str] = EXCLUDED_TYPES, column: str = "tipo") -> DataFrame:
    """Drop rows of the given types; rows without a type go too."""
    return df.filter(~F.col(column).isin(list(types)))


def between_dates(
    df: DataFrame, start: str = TRAINING_RANGE[0], end: str = TRAINING_RANGE[1], column: str = "week"
) -> DataFrame:
    """Keep rows whose date lies in the closed range."""
    return df.filter(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def flag_promo(df: DataFrame, column: str = "promo_id", name: str = "has_promo") -> DataFrame:
    return df.withColumn(name, F.col(column).isNotNull().cast("int"))


def flag_period(
    df: DataFrame, period: tuple[str, str] = FLAGGED_PERIOD, column: str = "calday", name: str = "is_covid_period"
) -> DataFrame:
    """1 inside the closed date range, else 0 (also for a missing date)."""
    return df.withColumn(name, in_period(F.col(column), period))


def in_period(date, period: tuple[str, str]):
    start, end = (F.lit(d).cast("date") for d in period)
    return F.when(date.between(start, end), 1).otherwise(0)


def drop_columns(df: DataFrame, columns: Iterable[str] = DROPPED_COLUMNS) -> DataFrame:
    """Drop the listed columns; unknown names are ignored."""
    return df.drop(*columns)


def contains_text(df: DataFrame, column: str, text: str) -> DataFrame:
    return df.filter(F.col(column).cast("string").contains(text))


def like_text(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """As ``contains_text`` but ``text`` may hold the wildcards % and _."""
    return df.filter(F.col(column).cast("string").like(f"%{pattern}%"))


def keep_items(df: DataFrame, items: Iterable[str] | DataFrame, column: str = "material") -> DataFrame:
    """Keep rows whose item is in a list, or in a table with a column of that name."""
    if isinstance(items, DataFrame):
        return df.join(items.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(list(items)))


def pick_series(df: DataFrame, *key_values, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """One series as (ds, y, flags) in time order."""
    for key, value in zip(spec.keys, key_values, strict=True):
        df = df.filter(F.col(key) == value)
    return as_model_input(df, spec).drop(*spec.keys).orderBy("ds")


def as_model_input(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """All series at once, with the time and value columns named ``ds`` and ``y``."""
    flags = [c for c in (spec.promo, spec.period) if c in df.columns]
    return df.select(*spec.keys, F.col(spec.time).alias("ds"), F.col(spec.value).cast("double").alias("y"), *flags)


def sale_weeks(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return df.filter(F.col(spec.value) > 0)


def fill_nulls(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULL per column; names that are not in the table are ignored."""
    return df.select(
        *[F.coalesce(F.col(c), F.lit(values[c]).cast(t)).alias(c) if c in values else F.col(c) for c, t in df.dtypes]
    )


def fill_matching(df: DataFrame, parts: Iterable[str], value=0) -> DataFrame:
    """Replace NULL in every numeric column whose name has one of the parts."""
    plain = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    names = [c for c, t in df.dtypes if t in plain and any(p in c for p in parts)]
    return fill_nulls(df, dict.fromkeys(names, value))


def fill_category(df: DataFrame, columns: Iterable[str], value: str = "Missing") -> DataFrame:
    """Categories as text, with one own value for missing ones."""
    wanted = set(columns)
    return df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(value)).alias(c) if c in wanted else c for c in df.columns]
    )


HISTORY_COLUMNS = ("lag_", "roll_", "days_since_last_sale")


def history_columns(df: DataFrame, parts: Iterable[str] = HISTORY_COLUMNS) -> list[str]:
    """The columns built from the past."""
    return [c for c in df.columns if any(p in c for p in parts)]


def drop_incomplete(df: DataFrame, parts: Iterable[str] = HISTORY_COLUMNS) -> DataFrame:
    """Drop rows that lack a value in a column built from the past."""
    columns = history_columns(df, parts)
    return df.na.drop(subset=columns) if columns else df


def is_complete(df: DataFrame, parts: Iterable[str] = HISTORY_COLUMNS) -> Column:
    """Whether ``drop_incomplete`` keeps a row: no column built from the past is null or NaN."""
    # Each column is named once: in a conjunction of tests the optimizer would copy its whole derivation for every test.
    values = F.array(*[F.col(c).cast("double") for c in history_columns(df, parts)])
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x))


def align_columns(df: DataFrame, expected: Iterable[str], fill=0) -> DataFrame:
    """Exactly the expected columns in that order; missing ones get the fill value."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in expected])


def bad_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row: for each column whether it has a NaN or an infinity."""
    return df.agg(*[F.coalesce(F.bool_or(is_bad(F.col(c).cast("double"))), F.lit(False)).alias(c) for c in columns])


def cast_weekly(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Types of a weekly table: text keys, a date, a double value, small flags (NULL where they do not parse)."""
    types = {spec.time: "date", spec.value: "double", spec.label: "int"} | dict.fromkeys(spec.keys, "string")
    out = []
    for c in df.columns:
        if c in (spec.promo, spec.period):
            out.append(F.col(c).try_cast("tinyint").alias(c))
        else:
            out.append(F.col(c).cast(types[c]).alias(c) if c in types else F.col(c))
    return df.select(*out)


Step = Callable[..., DataFrame] | tuple


def run_steps(df: DataFrame, steps: Iterable[Step], count_rows: bool = False) -> tuple[DataFrame, list]:
    """Chain ``DataFrame -> DataFrame`` functions, given as f, (f, args) or (f, args, kwargs).

    Nothing is computed here: the result is one plan. With ``count_rows`` each step carries an ``Observation``
    that the action on the result fills, without a job of its own.
    """
    observed = []
    for step in steps:
        parts = step if isinstance(step, tuple) else (step,)
        func = parts[0]
        args = parts[1] if len(parts) > 1 else []
        kwargs = parts[2] if len(parts) > 2 else {}
        df = df.transform(func, *args, **kwargs)
        if count_rows:
            seen = Observation()
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            observed.append((func.__name__, seen))
    return df, observed
