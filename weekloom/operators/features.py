"""Per-week features. All windows share one partitioning by series, so the table is shuffled once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.dates import cycle, week_of_year
from weekloom.functions.holidays import is_holiday, with_easter
from weekloom.functions.numeric import positive
from weekloom.operators.clean import cast_weekly, fill_matching
from weekloom.operators.lookup import lookup_join
from weekloom.settings import LAGS, ROLLING_WINDOWS
from weekloom.spec import DEFAULT, SeriesSpec, require_columns


def calendar_features(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    date = F.col(spec.time)
    month_sin, month_cos = cycle(F.month(date), 12)
    week_sin, week_cos = cycle(week_of_year(date), 52)
    return df.withColumns(
        {
            "year": F.year(date),
            "month": F.month(date),
            "week_of_year": week_of_year(date),
            "month_sin": month_sin,
            "month_cos": month_cos,
            "week_of_year_sin": week_sin,
            "week_of_year_cos": week_cos,
        }
    )


def holiday_features(
    df: DataFrame,
    holidays: DataFrame | None = None,
    country: str = "ES",
    region: str | None = None,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Holiday flag of the date itself, and of the row or one of the six rows before it.

    The rules of a known country are evaluated in place. A table (holiday_date, is_holiday_flag) is joined by date
    instead; it is broadcast after its rows have been counted.
    """
    if holidays is None:
        flag = is_holiday(F.col(spec.time), F.col("__easter"), country, region)
        df = with_easter(df, F.year(spec.time)).withColumn("is_holiday_exact_date", flag.cast("int")).drop("__easter")
    else:
        dates = holidays.groupBy(F.col("holiday_date").alias(spec.time)).agg(
            F.max("is_holiday_flag").cast("int").alias("__flag")
        )
        df = lookup_join(df, dates, [spec.time]).withColumn(
            "is_holiday_exact_date", F.coalesce(F.col("__flag"), F.lit(0))
        )
        df = df.drop("__flag")
    window = spec.in_time().rowsBetween(-6, 0)
    return df.withColumn("is_holiday_in_week", F.max("is_holiday_exact_date").over(window))


def holiday_in_week_days(
    df: DataFrame, country: str = "ES", region: str | None = None, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Holiday flag over the seven days of the week itself."""
    flags = [is_holiday(F.date_add(spec.time, d), F.col("__easter"), country, region) for d in range(7)]
    any_day = F.greatest(*[f.cast("int") for f in flags])
    return with_easter(df, F.year(spec.time)).withColumn("holiday_in_week_days", any_day).drop("__easter")


def lag_features(df: DataFrame, lags=tuple(LAGS), spec: SeriesSpec = DEFAULT) -> DataFrame:
    w = spec.in_time()
    return df.withColumns({f"volume_lag_{k}": F.lag(spec.value, k).over(w) for k in lags})


def _middle(values: Column, count: Column, skip: Column) -> Column:
    """Median of ``count`` sorted values that follow the first ``skip`` ones, NULL for none."""
    low = skip + F.floor((count + 1) / 2).cast("int")
    high = skip + F.floor(count / 2).cast("int") + 1
    return F.when(count > 0, (F.element_at(values, low) + F.element_at(values, high)) / F.lit(2.0))


def rolling_features(
    df: DataFrame, windows=tuple(ROLLING_WINDOWS), shift: int = 1, spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Statistics of the rows before the current one, over all weeks and over weeks with sales.

    With ``shift=1`` the frame of a window of w weeks is its w - 1 rows before the current row. With ``shift=0``
    it is the full w rows before the current row.

    Both medians, minimum and maximum of a window come from one sorted array, because ``percentile`` would build
    and sort its own table of values twice per row.
    """
    v = F.col(spec.value)
    sold = positive(v)
    gathered, out, arrays = {}, {}, []
    for w in windows:
        frame = spec.in_time().rowsBetween(-(w - shift), -1)
        values, rows, sales = f"__values_{w}", f"__rows_{w}", f"__sales_{w}"
        arrays += [values, rows]
        gathered |= {
            values: F.sort_array(F.collect_list(v).over(frame)),
            rows: F.count(F.lit(1)).over(frame),
            f"volume_roll_mean_{w}w": F.avg(v).over(frame),
            f"volume_roll_std_{w}w": F.stddev_samp(v).over(frame),
            f"volume_roll_count_nonzero_{w}w": F.count(sold).over(frame),
            f"volume_roll_mean_nonzero_{w}w": F.avg(sold).over(frame),
            f"volume_roll_std_nonzero_{w}w": F.stddev_samp(sold).over(frame),
        }
        size = F.size(values)
        sales = F.col(f"volume_roll_count_nonzero_{w}w").cast("int")
        out |= {
            f"volume_roll_median_{w}w": _middle(F.col(values), size, F.lit(0)),
            f"volume_roll_min_{w}w": F.when(size > 0, F.element_at(values, 1)),
            f"volume_roll_max_{w}w": F.when(size > 0, F.element_at(values, -1)),
            f"volume_roll_median_nonzero_{w}w": _middle(F.col(values), sales, size - sales),
            f"volume_roll_ratio_nonzero_{w}w": F.try_divide(sales.cast("double"), F.col(rows)),
        }
    order = [
        f"volume_roll_{name}_{w}w"
        for w in windows
        for name in (
            "mean",
            "median",
            "std",
            "min",
            "max",
            "count_nonzero",
            "mean_nonzero",
            "median_nonzero",
            "std_nonzero",
            "ratio_nonzero",
        )
    ]
    keep = df.columns
    return df.withColumns(gathered).withColumns(out).select(*keep, *order)


def intermittency(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Last week with sales before the current row and the days since then (0 before the first sale)."""
    before = spec.in_time().rowsBetween(Window.unboundedPreceding, -1)
    sale = F.when(F.col(spec.value) > 0, F.col(spec.time))
    return df.withColumn("last_sale_week", F.last(sale, ignorenulls=True).over(before)).withColumn(
        "days_since_last_sale", F.coalesce(F.datediff(spec.time, "last_sale_week"), F.lit(0))
    )


def row_features(
    df: DataFrame,
    holidays: DataFrame | None = None,
    country: str = "ES",
    region: str | None = None,
    lags=tuple(LAGS),
    windows=tuple(ROLLING_WINDOWS),
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """The whole feature table; rolling features of an empty frame are 0, lags before the start stay NULL."""
    require_columns(df, [*spec.keys, spec.time, spec.value])
    df = cast_weekly(df, spec)
    df = calendar_features(df, spec)
    df = holiday_features(df, holidays, country, region, spec)
    df = lag_features(df, lags, spec)
    df = rolling_features(df, windows, spec=spec)
    df = intermittency(df, spec)
    return fill_matching(df, ["roll_"])


def next_week_features(
    df: DataFrame,
    weeks_ahead: int = 1,
    promo: int | Column = 0,
    period: int = 0,
    holidays: DataFrame | None = None,
    country: str = "ES",
    region: str | None = None,
    lags=tuple(LAGS),
    windows=tuple(ROLLING_WINDOWS),
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Feature row of the week after the end of each series, by the same code as the training rows.

    Only the rows that a frame can reach are kept before the features are built; the last sale week, which may
    lie further back, is taken from the whole series.
    """
    reach = max([*lags, *windows, 7])
    latest_first = spec.by_series().orderBy(F.col(spec.time).desc())
    sale = F.when(F.col(spec.value) > 0, F.col(spec.time))
    tail = (
        df.withColumn("__last_sale", F.max(sale).over(spec.by_series()))
        .withColumn("__back", F.row_number().over(latest_first))
        .filter(F.col("__back") <= reach)
    )
    is_last = F.col("__back") == 1
    future = {
        spec.time: F.date_add(spec.time, 7 * weeks_ahead),
        spec.value: F.lit(None).cast(dict(df.dtypes)[spec.value]),
        spec.promo: (promo if isinstance(promo, Column) else F.lit(promo)).cast(dict(df.dtypes)[spec.promo]),
        spec.period: F.lit(period).cast(dict(df.dtypes)[spec.period]),
    }
    # One row becomes two at the end of a series; an explode keeps the partitioning, a union would not.
    names = [*df.columns, "__last_sale"]
    now = F.struct(*[F.col(c).alias(c) for c in names], F.lit(False).alias("__future"))
    then = F.struct(*[future.get(c, F.col(c)).alias(c) for c in names], F.lit(True).alias("__future"))
    rows = tail.select(
        F.explode(F.when(is_last, F.array(now, then)).otherwise(F.array(now))).alias("r")
    ).select(*[F.col(f"r.{c}").alias(c) for c in [*names, "__future"]])
    out = row_features(rows, holidays, country, region, lags, windows, spec).filter("__future")
    out = out.withColumn("last_sale_week", F.col("__last_sale")).withColumn(
        "days_since_last_sale", F.coalesce(F.datediff(spec.time, "__last_sale"), F.lit(0))
    )
    return out.drop("__future", "__last_sale")
