"""Operators that must give whole results however the rows are spread, also with one hot group."""

import numpy as np
import pytest
from conftest import week
from pyspark.sql import functions as F

from weekloom.operators import metrics, sampling, scale, split, weekly as wk
from weekloom.operators.lookup import bounded, lookup_join, running_total
from weekloom.operators.tabular import day_windows


def hot_rows(spark, n=3000):
    """A third of the rows in one group."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") % 17) + 1).cast("int").alias("g"),
        (F.col("id") * 7919 % 1009).cast("int").alias("x"),
        "id",
    )


def test_running_total_over_blocks(spark):
    df = hot_rows(spark)
    out = running_total(df, ["g"], ["x", "id"], F.lit(1)).toPandas().sort_values(["g", "x", "id"])
    assert len(out) == 3000
    assert (out["__before"] == out.groupby("g").cumcount()).all()
    assert (out["__total"] == out.groupby("g")["id"].transform("size")).all()


def test_running_total_without_group_and_with_null_group(spark):
    df = hot_rows(spark, 500).withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    out = running_total(df, [], ["x", "id"], F.lit(2)).toPandas().sort_values(["x", "id"])
    assert out["__before"].tolist() == list(range(0, 1000, 2))
    grouped = running_total(df, ["g"], ["x", "id"], F.lit(1))
    assert grouped.count() == 500
    assert grouped.filter("g is null").agg(F.max("__before")).first()[0] == df.filter("g is null").count() - 1


def test_lookup_join_beyond_the_limit(spark):
    df = hot_rows(spark)
    small = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert bounded(small, 3) is None
    a, b = lookup_join(df, small, ["g"], "inner"), lookup_join(df, small, ["g"], "inner", limit=3)
    assert a.count() == 3000 and a.select("g", "x", "id", "n").exceptAll(b.select("g", "x", "id", "n")).count() == 0
    left = lookup_join(df, small.filter("g < 5"), ["g"], "left", limit=1)
    assert left.count() == 3000 and left.filter("g = 9 and n is null").count() > 0


def test_medians_leave_out_nan_as_null(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (float("nan"),), (None,)], "x double")
    assert scale.median_values(df, ["x"]) == {"x": 1.5}
    assert scale.median_values(df, ["x"], approximate=True) == {"x": 1.0}
    assert scale.median_values(df.filter("x is null"), ["x"]) == {"x": 0.0}


def test_exact_medians(spark):
    df = hot_rows(spark).select(F.col("x").cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.col("x") + 0.5).alias("b"))
    got = {r["feature"]: r["median"] for r in scale.exact_medians(df, ["a", "b"]).collect()}
    pdf = df.toPandas()
    assert got == {"a": pdf["a"].median(), "b": pdf["b"].median()}
    assert scale.median_values(df, ["a", "b"]) == {"b": pdf["b"].median()}


@pytest.mark.parametrize("rows", [1, 40, 500, 10_000])
def test_sample_rows_is_exact(random_weekly, rows):
    got = sampling.sample_rows(random_weekly, rows)
    assert got.exceptAll(sampling.sample_rows(random_weekly.repartition(13), rows)).count() == 0
    sizes = {r["cluster_label"]: r["count"] for r in random_weekly.groupBy("cluster_label").count().collect()}
    assert {r["cluster_label"]: r["count"] for r in got.groupBy("cluster_label").count().collect()} == {
        g: min(rows, n) for g, n in sizes.items()
    }


def test_sample_only_large_groups(random_weekly):
    assert sampling.sample_large_groups(random_weekly).count() == random_weekly.count()
    assert sampling.sample_large_groups(random_weekly, 0.5, 10).count() < random_weekly.count()


def test_positions_and_folds(random_weekly):
    out = split.positions(random_weekly).toPandas().sort_values(["cluster_label", "establecimiento", "material", "week"])
    assert (out["pos"] == out.groupby("cluster_label").cumcount()).all()
    folded = split.cv_folds(random_weekly, 5, "positional").toPandas()
    folded = folded.sort_values(["cluster_label", "establecimiento", "material", "week"])
    for _, g in folded.groupby("cluster_label"):
        n, size = len(g), len(g) // 6
        want = np.full(n, -1)
        for f in range(5):
            start = n - (5 - f) * size
            want[start : start + size] = f
        assert (g["fold"].to_numpy() == want).all()


def test_chronological_folds_never_look_ahead(random_weekly):
    folded = split.cv_folds(random_weekly, 4)
    ends = folded.groupBy("cluster_label", "fold").agg(F.min("week").alias("a"), F.max("week").alias("b")).toPandas()
    for _, g in ends.groupby("cluster_label"):
        g = g.sort_values("fold")
        assert g["fold"].tolist() == [-1, 0, 1, 2, 3]
        assert (g["b"].to_numpy()[:-1] < g["a"].to_numpy()[1:]).all()


def test_splits(random_weekly, weekly):
    out = split.chronological_split(random_weekly, 12)
    test = out.filter("split = 'test'")
    assert test.groupBy("cluster_label").agg(F.count_distinct("week").alias("n")).filter("n <> 12").count() == 0
    whole = split.chronological_split(random_weekly, 12, group=[])
    assert whole.columns == [*random_weekly.columns, "cutoff_week", "split"]
    short = split.chronological_split(weekly({("a", "x"): [(0, 1.0), (1, 1.0)]}), 12).orderBy("week").collect()
    assert [r["split"] for r in short] == ["train", "test"]
    shares = split.week_share_split(random_weekly, 0.8).groupBy("cluster_label", "split").agg(F.max("week").alias("w"), F.min("week").alias("v"))
    parts = {(r["cluster_label"], r["split"]): r for r in shares.collect()}
    assert all(parts[(g, "train")]["w"] < parts[(g, "test")]["v"] for g in range(3))


def test_backtest_rows_match_cutoffs(random_weekly):
    cutoffs = split.backtest_cutoffs(random_weekly, 26, 8, 20)
    want = (
        random_weekly.join(cutoffs, ["establecimiento", "material"])
        .filter("week > cutoff and datediff(week, cutoff) <= 140")
        .select("establecimiento", "material", "week", "cutoff")
    )
    got = split.backtest_rows(random_weekly, 26, 8, 20).select("establecimiento", "material", "week", "cutoff")
    assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_recent_rows_keeps_ties(weekly):
    df = weekly({("a", "x"): [(i, 1.0) for i in range(5)], ("a", "y"): [(i, 1.0) for i in range(5)]})
    assert wk.recent_rows(df, 3).count() == 4
    assert wk.recent_rows(df, 100).count() == 10


def test_mase_boundaries(random_weekly):
    pdf = random_weekly.toPandas().sort_values(["cluster_label", "establecimiento", "material", "week"])
    predictions = random_weekly.select(
        "cluster_label", F.col("weekly_volume").alias("actual_volume"), F.lit(3.0).alias("predicted_volume")
    )
    for boundary, keys in (("continuous", ["cluster_label"]), ("per_series", ["cluster_label", "establecimiento", "material"])):
        steps = pdf.groupby(keys)["weekly_volume"].diff().abs()
        want = (pdf["weekly_volume"] - 3).abs().groupby(pdf["cluster_label"]).mean() / steps.groupby(pdf["cluster_label"]).mean()
        got = {r["cluster_label"]: r["mase"] for r in metrics.mase(random_weekly, predictions, boundary).collect()}
        assert got == pytest.approx(want.to_dict())


def test_a_null_group_keeps_its_border_steps(weekly):
    df = weekly({("a", "x"): [(0, 2.0)], ("a", "y"): [(0, 5.0)]})
    whole = df.withColumn("cluster_label", F.lit(None).cast("int"))
    scale = metrics.naive_scale(whole, "continuous").first()
    assert scale["naive_mae"] == 3.0 and scale["train_rows"] == 2


def test_mase_of_flat_and_short_training(weekly):
    flat = weekly({("a", "x"): [(i, 2.0) for i in range(5)]})
    right = flat.select("cluster_label", F.col("weekly_volume").alias("actual_volume"), F.lit(2.0).alias("predicted_volume"))
    wrong = right.withColumn("predicted_volume", F.lit(3.0))
    assert metrics.mase(flat, right).first()["mase"] == 0
    assert metrics.mase(flat, wrong).first()["mase"] == float("inf")
    assert metrics.mase(flat.limit(1), wrong).first()["mase"] is None


def test_cluster_metrics(spark):
    df = spark.createDataFrame([(0, 2.0, 1.0), (0, 4.0, 5.0), (1, 0.0, 1.0), (1, 0.0, 1.0)], "cluster_label int, actual_volume double, predicted_volume double")
    out = {r["cluster_label"]: r for r in metrics.cluster_metrics(df).collect()}
    assert (out[0]["mae"], out[0]["rmse"], out[0]["mape"], out[0]["r2"]) == (1.0, 1.0, 0.375, 0.0)
    assert (out[1]["mape"], out[1]["r2"]) == (None, 0.0)


def test_day_windows_against_pandas(spark):
    rows = [(k, week(0 + i * i % 11), float(i * 13 % 7) + 1e6) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    got = day_windows(df, ["k"], "d", "v", [14]).toPandas()
    pdf = df.toPandas()
    for _, r in got.iterrows():
        days = (np.datetime64(r["d"]) - pdf["d"].to_numpy("datetime64[D]")).astype(int)
        part = pdf[(pdf["k"] == r["k"]) & (days >= 0) & (days < 14)]["v"]
        assert r["sum_14d"] == pytest.approx(part.sum())
        assert r["std_14d"] == pytest.approx(part.std(), rel=1e-6)
