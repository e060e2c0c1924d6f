import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import week
from pyspark.sql import functions as F

from weekloom.functions.dates import week_of_year
from weekloom.functions.holidays import holiday_calendar
from weekloom.operators import features as ft
from weekloom.settings import ROLLING_WINDOWS


def test_week_of_year_is_not_iso(spark):
    days = [dt.date(1997, 1, 1), dt.date(1998, 1, 5), dt.date(2000, 12, 31), dt.date(2001, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select(week_of_year(F.col("d")))
    assert [r[0] for r in df.collect()] == [int(d.strftime("%W")) for d in days] == [0, 1, 52, 1]


def test_easter(spark):
    # Easter Mondays.
    known = [dt.date(1998, 4, 13), dt.date(2000, 4, 24), dt.date(2008, 3, 24), dt.date(2024, 4, 1), dt.date(2038, 4, 26)]
    found = {r[0] for r in holiday_calendar(spark, 1998, 2038, "ES", "CT").select("holiday_date").collect()}
    assert set(known) <= found
    assert dt.date(2024, 3, 29) in found and dt.date(2024, 9, 11) in found


def test_holidays_by_rule_and_by_table(spark, random_weekly):
    a = ft.holiday_features(random_weekly)
    b = ft.holiday_features(random_weekly, holiday_calendar(spark, 1990, 2010))
    assert a.select(*b.columns).exceptAll(b).count() == 0


def test_unknown_country_needs_a_table(random_weekly):
    with pytest.raises(ValueError, match="pass a table"):
        ft.holiday_features(random_weekly, country="XX")


def test_rolling_against_pandas(random_weekly):
    out = ft.rolling_features(random_weekly).toPandas().sort_values(["establecimiento", "material", "week"])
    for _, g in out.groupby(["establecimiento", "material"]):
        v = g["weekly_volume"]
        sold = v.where(v > 0)
        for w in ROLLING_WINDOWS:
            past, past_sold = v.shift(1).rolling(w - 1, min_periods=1), sold.shift(1).rolling(w - 1, min_periods=1)
            for name, want in {
                "mean": past.mean(), "median": past.median(), "std": past.std(), "min": past.min(), "max": past.max(),
                "mean_nonzero": past_sold.mean(), "median_nonzero": past_sold.median(), "std_nonzero": past_sold.std(),
            }.items():
                got = g[f"volume_roll_{name}_{w}w"].to_numpy(float)
                np.testing.assert_allclose(got, want.to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=f"{name} {w}")


def test_no_feature_sees_the_present_or_future(random_weekly):
    cut = week(50)
    changed = random_weekly.withColumn(
        "weekly_volume", F.when(F.col("week") >= F.lit(cut), F.lit(1000.0)).otherwise(F.col("weekly_volume"))
    )
    a, b = (ft.row_features(d).filter(F.col("week") <= F.lit(cut)).drop("weekly_volume") for d in (random_weekly, changed))
    assert a.exceptAll(b).count() == 0


def test_first_rows(weekly):
    rows = ft.row_features(weekly({("a", "x"): [(0, 0.0), (1, 4.0), (2, 0.0)]})).orderBy("week").collect()
    assert rows[0]["volume_lag_1"] is None and rows[0]["volume_roll_mean_4w"] == 0
    assert [r["days_since_last_sale"] for r in rows] == [0, 0, 7]
    assert rows[2]["last_sale_week"] == week(1)


def test_missing_values_in_a_frame(weekly):
    df = weekly({("a", "x"): [(0, 1.0), (1, None), (2, 3.0), (3, 0.0)]})
    row = ft.rolling_features(df, [4]).orderBy("week").collect()[3]
    assert (row["volume_roll_median_4w"], row["volume_roll_mean_4w"]) == (2.0, 2.0)
    assert row["volume_roll_ratio_nonzero_4w"] == pytest.approx(2 / 3)


def test_next_week_equals_training_code(random_weekly):
    ahead = ft.next_week_features(random_weekly, promo=1).toPandas()
    ends = random_weekly.groupBy("establecimiento", "material").agg(F.max("week").alias("week"))
    extra = ends.select(
        "establecimiento", "material", F.date_add("week", 7).alias("week"), F.lit(None).cast("double").alias("weekly_volume"),
        F.lit(1).alias("has_promo"), F.lit(0).alias("is_covid_period"),
    )
    labels = random_weekly.select("establecimiento", "material", "cluster_label").distinct()
    long = random_weekly.unionByName(extra.join(labels, ["establecimiento", "material"]))
    want = ft.row_features(long).filter("weekly_volume is null").toPandas()
    order = ["establecimiento", "material"]
    pd.testing.assert_frame_equal(
        ahead.sort_values(order).reset_index(drop=True),
        want[ahead.columns].sort_values(order).reset_index(drop=True),
    )


def test_feature_plan_has_one_shuffle(random_weekly, spark, tmp_path):
    random_weekly.write.parquet(str(tmp_path / "w"))
    plan = ft.row_features(spark.read.parquet(str(tmp_path / "w")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastExchange" not in plan and "CartesianProduct" not in plan
