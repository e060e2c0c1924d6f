import datetime as dt

import pytest
from conftest import week
from pyspark.sql import functions as F

from weekloom.operators import clean, describe, weekly as wk
from weekloom.spec import MissingColumns, feature_columns, require_columns, split_by_type


def test_exclude_types_drops_missing_types(spark):
    df = spark.createDataFrame([("KAM",), ("A",), (None,)], "tipo string")
    assert [r[0] for r in clean.exclude_types(df).collect()] == ["A"]


def test_flags(spark):
    df = spark.createDataFrame(
        [("P1", dt.date(2020, 3, 1)), (None, dt.date(2022, 4, 30)), (None, dt.date(2022, 5, 1)), ("x", None)],
        "promo_id string, calday date",
    )
    out = clean.flag_period(clean.flag_promo(df)).select("has_promo", "is_covid_period").collect()
    assert [tuple(r) for r in out] == [(1, 1), (0, 1), (0, 0), (1, 0)]


def test_drop_columns_ignores_unknown_names(spark):
    df = spark.createDataFrame([(1, 2)], "tipo int, b int")
    assert clean.drop_columns(df).columns == ["b"]


def test_text_filters(spark):
    df = spark.createDataFrame([("a_1",), ("ab1",), (None,)], "s string")
    assert clean.contains_text(df, "s", "a_").count() == 1
    assert clean.like_text(df, "s", "a_").count() == 2


def test_gap_filling(weekly):
    df = weekly({("a", "x"): [(0, 3.0, 1), (1, 1.0), (4, 2.0), (8, 5.0, 1)]}).drop("cluster_label")
    out = wk.fill_gaps(df, (str(week(2)), str(week(3)))).orderBy("week").collect()
    assert [r["week"] for r in out] == [week(i) for i in range(9)]
    assert [r["weekly_volume"] for r in out] == [3, 1, 0, 0, 2, 0, 0, 0, 5]
    assert [r["has_promo"] for r in out] == [1, 0, 0, 0, 0, 0, 0, 0, 1]
    assert [r["is_covid_period"] for r in out] == [0, 0, 1, 1, 0, 0, 0, 0, 0]


def test_min_weeks_and_order(weekly):
    df = weekly({("a", "x"): [(i, 1.0) for i in range(3)], ("b", "x"): [(i, 9.0) for i in range(2)]})
    assert wk.min_weeks(df, 3).select("establecimiento").distinct().collect()[0][0] == "a"
    first = wk.sort_by_volume(df).first()
    assert (first["establecimiento"], first["week"]) == ("b", week(0))


def test_weekly_rollup_keeps_volume(spark):
    rows = [("a", "x", dt.date(1998, 1, 4), 2.0, 0, 0), ("a", "x", dt.date(1998, 1, 5), 3.0, 1, 0),
            ("a", "x", dt.date(1998, 1, 11), 4.0, 0, 1)]
    df = spark.createDataFrame(
        rows, "establecimiento string, material string, calday date, volume_ap double, has_promo int, is_covid_period int"
    )
    out = {r["week"]: (r["weekly_volume"], r["has_promo"], r["is_covid_period"]) for r in wk.weekly_rollup(df).collect()}
    assert out == {dt.date(1997, 12, 29): (2.0, 0, 0), dt.date(1998, 1, 5): (7.0, 1, 1)}


def test_series_features_of_odd_series(weekly):
    df = weekly(
        {
            ("a", "one"): [(0, 5.0)],
            ("a", "zero"): [(i, 0.0) for i in range(10)],
            ("a", "gap"): [(i, 4.0 if i in (0, 1, 4, 8) else 0.0) for i in range(9)],
            ("a", "promo"): [(i, 3.0, 1) for i in range(8)],
            ("a", "even"): [(0, 1.0), (1, 2.0), (2, 3.0), (3, 10.0)],
        }
    )
    out = {r["material"]: r for r in describe.series_features(df).collect()}
    assert (out["one"]["std_liters"], out["one"]["adi"], out["one"]["promo_lift"]) == (0, 1, 1)
    zero = out["zero"]
    assert (zero["mean_nonzero_liters"], zero["cv_squared"], zero["zero_ratio"], zero["adi"]) == (0, 0, 1, 10)
    assert out["gap"]["adi"] == pytest.approx(8 / 3)
    assert out["promo"]["promo_lift"] == 1
    assert out["even"]["median_liters"] == 2.5


def test_interval_mean_equals_window_form(random_weekly):
    windowed = describe.sale_intervals(random_weekly).groupBy("establecimiento", "material").agg(
        F.avg("interval_weeks").alias("w")
    )
    both = describe.mean_interval(random_weekly).join(windowed, ["establecimiento", "material"], "full")
    assert both.filter("w is null or adi_weeks is null or abs(w - adi_weeks) > 1e-9").count() == 0


def test_profile_leaves_out_missing_columns(spark):
    out = describe.dataset_profile(spark.createDataFrame([("a",)], "material string"))
    assert out.columns == ["row_count", "unique_items"]
    empty = spark.createDataFrame([], "has_promo int")
    assert describe.dataset_profile(empty).first()["promo_pct"] == 0


def test_fills_and_alignment(spark):
    df = spark.createDataFrame([(None, None, "a"), (2.0, 1, None)], "roll_x double, days int, c string")
    out = clean.fill_matching(df, ["roll_"]).collect()
    assert (out[0]["roll_x"], out[0]["days"]) == (0.0, None)
    assert clean.fill_category(df, ["c"]).collect()[1]["c"] == "Missing"
    assert clean.align_columns(df, ["c", "new"]).columns == ["c", "new"]
    assert clean.fill_nulls(df, {"days": 7, "nope": 1}).collect()[0]["days"] == 7


def test_bad_values(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (2.0, 3.0)], "a double, b double")
    row = clean.bad_values(df, ["a", "b"]).first()
    assert (row["a"], row["b"]) == (False, True)


def test_steps_count_rows_without_extra_jobs(spark):
    df = spark.createDataFrame([("KAM", "x"), ("A", None)], "tipo string, promo_id string")
    out, seen = clean.run_steps(df, [clean.exclude_types, (clean.flag_promo, ["promo_id"], {"name": "p"})], True)
    out.collect()
    assert [(name, o.get["rows"]) for name, o in seen] == [("exclude_types", 1), ("flag_promo", 1)]


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "x int, s string, y double")
    assert split_by_type(df, feature_columns(df, ["y"])) == (["x"], ["s"])
    with pytest.raises(MissingColumns, match="q, z"):
        require_columns(df, ["z", "x", "q"])
