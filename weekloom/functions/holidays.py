"""Public holidays as rules: fixed dates and days relative to Easter Sunday."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (month, day) of the holidays of a country or region; None is the whole country.
FIXED_DATES = {
    ("ES", None): [(1, 1), (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), (12, 25)],
    ("ES", "CT"): [(6, 24), (9, 11), (12, 26)],
}

# Days from Easter Sunday; Good Friday is -2, Easter Monday is 1.
EASTER_OFFSETS = {
    ("ES", None): [-2],
    ("ES", "CT"): [1],
}

MAX_CALENDAR_ROWS = 50_000


def _rules(table: dict, country: str, region: str | None) -> list:
    if (country, None) not in table:
        raise ValueError(f"no holiday rules for {country}; pass a table of dates instead")
    if region is not None and (country, region) not in table:
        raise ValueError(f"no holiday rules for {country}-{region}; pass a table of dates instead")
    return table[(country, None)] + (table[(country, region)] if region else [])


def with_easter(df: DataFrame, year: Column, name: str = "__easter") -> DataFrame:
    """Add Gregorian Easter Sunday (the anonymous computus of Meeus, Jones and Butcher).

    Each step is a column of its own: as one expression the repeated parts would be copied many times over.
    """

    def div(a, b):
        return F.floor(a / F.lit(b)).cast("int")

    def c(column):
        return F.col(f"{name}_{column}")

    steps = {
        "year": year,
        "golden": c("year") % 19,
        "century": div(c("year"), 100),
        "skipped": c("century") - div(c("century"), 4) - div(c("century") - div(c("century") + 8, 25) + 1, 3),
        "epact": (c("golden") * 19 + c("skipped") + 15) % 30,
        "rest": (c("century") % 4) * 2 + div(c("year") % 100, 4) * 2 - (c("year") % 100) % 4,
        "sunday": (F.lit(32) + c("rest") - c("epact")) % 7,
        "late": div(c("golden") + c("epact") * 11 + c("sunday") * 22, 451),
        "day": c("epact") + c("sunday") - c("late") * 7 + 114,
    }
    for step, expression in steps.items():
        df = df.withColumn(f"{name}_{step}", expression)
    df = df.withColumn(name, F.make_date(c("year"), div(c("day"), 31), c("day") % 31 + 1))
    return df.drop(*[f"{name}_{step}" for step in steps])


def is_holiday(date: Column, easter: Column, country: str = "ES", region: str | None = None) -> Column:
    """Holiday test of a date, given Easter of its year: no calendar, no join, valid for every year."""
    fixed = _rules(FIXED_DATES, country, region)
    offsets = _rules(EASTER_OFFSETS, country, region)
    month_day = F.month(date) * 100 + F.dayofmonth(date)
    return month_day.isin([m * 100 + d for m, d in fixed]) | F.datediff(date, easter).isin(offsets)


def holiday_calendar(
    spark: SparkSession, first_year: int, last_year: int, country: str = "ES", region: str | None = None
) -> DataFrame:
    """Holiday dates of a range of years. Its size follows from the range, never from the data."""
    fixed = _rules(FIXED_DATES, country, region)
    offsets = _rules(EASTER_OFFSETS, country, region)
    rows = (last_year - first_year + 1) * (len(fixed) + len(offsets))
    if rows > MAX_CALENDAR_ROWS:
        raise ValueError(f"a calendar of {rows} rows is not meant to be broadcast")
    years = with_easter(spark.range(first_year, last_year + 1), F.col("id").cast("int"))
    days = [F.make_date(F.col("id").cast("int"), F.lit(m), F.lit(d)) for m, d in fixed]
    days += [F.date_add("__easter", o) for o in offsets]
    return (
        years.select(F.explode(F.array(*days)).alias("holiday_date"))
        .distinct()
        .withColumn("is_holiday_flag", F.lit(1).cast("tinyint"))
    )
