import threading

import numpy as np
import pandas as pd
import pytest
from conftest import week
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from weekloom.functions import additive
from weekloom.operators import cluster, encode, features, forecast as fc, results, route, split, stack, target_stats, trees
from weekloom.operators.scale import Scaler
from weekloom.plans.batch_forecast import read_results, run_forecasts
from weekloom.plans.grouping import group_series
from weekloom.plans.inference import predict_next_week
from weekloom.session import stage

FOREST = {"numTrees": [3, 4], "maxDepth": [3]}
BOOSTED = {"maxIter": [2], "maxDepth": [2, 3]}


@pytest.fixture(scope="module")
def table(random_weekly):
    return stage(features.row_features(random_weekly), ["cluster_label"])


def test_scaler_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, b double")
    scaler = Scaler.fit(df, ["a", "b"])
    out = scaler.transform(df).toPandas()
    assert out["a"].std(ddof=0) == pytest.approx(1) and (out["b"] == 0).all()
    scaler.save(spark, str(tmp_path / "s"))
    back = Scaler.load(spark, str(tmp_path / "s")).inverse(scaler.transform(df)).toPandas()
    pd.testing.assert_frame_equal(back, df.toPandas())


def test_clusters_are_nearest_and_ordered(spark, tmp_path):
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    rows = [(str(i), "m", float(a), float(b)) for i, (a, b) in enumerate(points)]
    df = spark.createDataFrame(rows, "establecimiento string, material string, total_liters double, adi double")
    found = cluster.Clusters.fit(df, 3)
    assert [round(c[0]) for c in found.centroids] == [10, 5, 0]
    out = found.assign(df).toPandas()
    distance = ((out[["total_liters", "adi"]].to_numpy()[:, None] - np.array(found.centroids)[None]) ** 2).sum(2)
    assert (distance.argmin(1) == out["cluster_label"]).all()
    found.save(spark, str(tmp_path / "c"))
    assert cluster.Clusters.load(spark, str(tmp_path / "c")) == found

    table = cluster.sweep(df, [2, 3, 4]).toPandas()
    assert table["inertia"].is_monotonic_decreasing and table["silhouette"].idxmax() == 1
    labelled = found.assign(df)
    mine = cluster.silhouette(labelled, ["total_liters", "adi"]).first()["silhouette"]
    assert mine == pytest.approx(table["silhouette"][1], abs=1e-6)


def test_silhouette_of_single_member_cluster(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (9.0, 1)], "x double, cluster_label int")
    want = np.mean([(81 - 1) / 81, (64 - 1) / 64, 0])
    assert cluster.silhouette(df, ["x"]).first()["silhouette"] == pytest.approx(want)


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.2]
    y = x @ [1.0, -2.0, 3.0] + 4 + rng.normal(size=80)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)
    model = stack.ridge(df, 1.0, "v", "y").fit(df)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    assert model.coefficients.toArray() == pytest.approx(want, rel=1e-5)


def test_encoder(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, None), (10.0, "a")], "x double, c string")
    model, _ = encode.fit_encoder(df, ["x"], ["c"])
    new = spark.createDataFrame([(None, "unseen"), (2.0, "a")], "x double, c string")
    rows = [r[0].toArray().tolist() for r in model.transform(new).select(encode.VECTOR).collect()]
    assert rows[0] == [3.0, 0, 0, 0] and rows[1][0] == 2.0 and sum(rows[1][1:]) == 1
    hashed, _ = encode.fit_encoder(df, ["x"], ["c"], max_categories=1)
    assert hashed.transform(df).first()[encode.VECTOR].size == 1 + encode.HASH_DIMENSIONS


def test_draws_are_different_and_repeatable():
    draws = trees.draw_params(trees.BOOSTED_SPACE, 10)
    assert draws == trees.draw_params(trees.BOOSTED_SPACE, 10)
    assert len({str(d) for d in draws}) == 10


@pytest.mark.parametrize("family, space", [("forest", FOREST), ("boosted", BOOSTED)])
def test_models_per_cluster(spark, table, tmp_path, family, space):
    path = str(tmp_path / "models")
    out = trees.train_clusters(table, family, space, trials=2, folds=2, models_path=path)
    found = out.metrics.toPandas()
    assert set(found["cluster_label"]) == {0, 1, 2} and (found["status"] == "ok").all()
    assert found[["mae", "rmse", "r2", "mase", "cv_mae"]].notna().all().all()
    test = split.week_share_split(table).filter("split = 'test'")
    assert out.predictions.count() == test.count()
    again = trees.predict_clusters(test, trees.load_models(spark, path, [0, 1, 2]))
    assert again.exceptAll(out.predictions).count() == 0


def test_models_without_a_list_of_categories(spark, table):
    """Trained on target statistics: rows apart get theirs from the history, and the predictions are the same."""
    out = trees.train_clusters(table, "forest", FOREST, trials=1, folds=2, mode="target")
    assert set(out.metrics.toPandas()["status"]) == {"ok"}
    test = split.week_share_split(table).filter("split = 'test'")
    seen = target_stats.ordered_target_statistics(table).join(test.select("establecimiento", "material", "week"), ["establecimiento", "material", "week"])
    again = trees.predict_clusters(seen, out.models)
    assert again.exceptAll(out.predictions).count() == 0 and out.predictions.count() == test.count()
    assert all("StringIndexer" not in str(m.stages) for m in out.models.values())


def test_short_and_broken_clusters_do_not_end_the_others(weekly):
    series = {("s0", "m"): [(i, float(i % 5)) for i in range(80)], ("s1", "m"): [(i, 1.0) for i in range(13)]}
    df = features.row_features(weekly(series, lambda key: int(key[0][1])))
    out = trees.train_clusters(df, "forest", FOREST, trials=1, folds=5)
    assert {r[0]: r[1] for r in out.metrics.select("cluster_label", "status").collect()} == {0: "ok", 1: "skipped: too few rows"}
    bad = trees.train_clusters(df, "forest", {"maxDepth": [99]}, trials=1, folds=2)
    assert all(r["status"].startswith(("failed", "skipped")) for r in bad.metrics.collect())
    assert bad.predictions.count() == 0


def test_stacking(spark, table, tmp_path):
    base = {"lossType": "absolute", "maxIter": 3, "maxDepth": 2}
    predictions, scores = stack.stack_clusters(table, 2, base, test_weeks=6, path=str(tmp_path / "s"))
    assert set(scores.toPandas()["status"]) == {"ok"}
    assert predictions.filter("stacking_predicted_volume < 0").count() == 0
    rows = stack.prepare(table, 6).filter("split = 'test'")
    assert predictions.count() == rows.count()
    model = stack.Stack.load(str(tmp_path / "s" / "cluster=1"))
    again = model.predict(rows.filter("cluster_label = 1"))
    assert again.count() == predictions.filter("cluster_label = 1").count()
    done = spark.createDataFrame([(0,), (1,)], "cluster_label int")
    _, rest = stack.stack_clusters(
        table, 2, base, meta="boosted", meta_params={"maxIter": 2}, test_weeks=6, max_rows=500, done=done
    )
    assert [r["cluster_label"] for r in rest.collect()] == [2]


def test_best_prefix_has_patience():
    assert stack.best_prefix([5, 4, 4.5, 4.4, 3, 3.5, 3.6, 3.7, 1], 3) == 5
    assert stack.best_prefix([5, 4, 4.5, 4.4, 3, 3.5, 3.6, 3.7, 1], 5) == 9
    assert stack.best_prefix([2.0], 50) == 1


def test_base_model_keeps_the_trees_that_help(weekly):
    """The second tree of the absolute loss may be worse than the first; the signal needs far more than one."""
    rng = np.random.default_rng(4)
    series = {(f"s{s}", "m"): [(i, 20.0 * s + 10 * (i % 4) + rng.normal(0, 1)) for i in range(60)] for s in range(6)}
    df = weekly(series).withColumn("slot", F.weekofyear("week") % 4 + F.rand(7) / 10)
    train = stage(split.cv_folds(df, 2, "chronological", group=[]))
    params = {**stack.STACK_BASE_CLUSTER, "maxIter": 80, "maxDepth": 3, "minInstancesPerNode": 5, "stepSize": 0.1}
    past, ahead = train.filter("fold < 1"), train.filter("fold = 1")
    model = stack.fit_base(past, params, F.col("fold") == 0, patience=20)
    assert model.stages[-1].getNumTrees > 20
    seen = stack._predict(model, ahead, "p").select("weekly_volume", "p").toPandas()
    mean = past.agg(F.avg("weekly_volume")).first()[0]
    assert (seen["weekly_volume"] - seen["p"]).abs().mean() < 0.5 * (seen["weekly_volume"] - mean).abs().mean()
    first = train.filter("fold < 0")
    held = first.filter(stack.latest_weeks(first)).count()
    assert 0 < held <= first.count() / 4
    assert stack.latest_weeks(first.limit(1)) is None and stack.latest_weeks(first.limit(0)) is None


def test_out_of_fold_rows(table):
    train = split.cv_folds(stack.prepare(table, 6, []).filter("split = 'train'"), 2, group=[])
    base = {"maxIter": 2, "maxDepth": 2}
    filled = stack.out_of_fold(stage(train), 2, base)
    assert filled.count() == train.count() and filled.filter("oof_pred is null").count() == 0
    early = filled.filter("fold < 0").agg(F.count_distinct("oof_pred")).first()[0]
    assert early == 1
    dropped = stack.out_of_fold(stage(train), 2, base, fill="drop")
    assert dropped.count() == train.filter("fold >= 0").count()


def meeting(monkeypatch, module, name, parties):
    """The function goes on only once that many calls of it run at the same time."""
    door, real = threading.Barrier(parties), getattr(module, name)

    def wait(*args, **kwargs):
        door.wait(timeout=120)
        return real(*args, **kwargs)

    monkeypatch.setattr(module, name, wait)


def test_base_models_of_a_stack_do_not_wait_for_each_other(table, monkeypatch):
    rows = stage(stack.prepare(table, 6, []))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    base = {**stack.STACK_BASE_CLUSTER, "maxIter": 2, "maxDepth": 2}
    folded = stage(split.cv_folds(train, 2, group=[]))
    level_one = stack.out_of_fold(folded, 2, base, threads=1)
    alone = stack.Stack(stack.fit_base(folded, base, F.col("fold") == 1), stack.fit_meta(level_one))
    meeting(monkeypatch, stack, "fit_base", 3)
    found = stack.fit_stack(train, 2, base)
    order = ["establecimiento", "material", "week"]
    want, got = (m.predict(test).toPandas().sort_values(order, ignore_index=True) for m in (alone, found))
    assert len(got) == test.count() and got.drop(columns="stacking_predicted_volume").equals(want.drop(columns="stacking_predicted_volume"))
    assert got["stacking_predicted_volume"].to_numpy() == pytest.approx(want["stacking_predicted_volume"].to_numpy())


def test_folds_of_a_search_do_not_wait_for_each_other(table, monkeypatch):
    train = stage(split.cv_folds(table, 2, group=[]))
    candidates = trees.draw_params(FOREST, 2)
    alone = trees.search(train, "forest", candidates, 2, folds_at_once=1)
    meeting(monkeypatch, trees, "fit_encoder", 2)
    best, error = trees.search(train, "forest", candidates, 2)
    assert best == alone[0] and error == pytest.approx(alone[1])


def test_routes(spark):
    df = spark.createDataFrame([(i,) for i in (-1, 0, 1, 2, 9)], "cluster_label int")
    got = [r["model_type"].split(" ", 1) for r in route.with_route(df).orderBy("cluster_label").collect()]
    assert [g[0] for g in got] == ["LightGBM", "LightGBM", "LightGBM", "RandomForest", "LightGBM"]
    assert got[0][1] == got[4][1] == "(Default)" and got[2][1] == "(Low Confidence)"


def test_next_week_predictions(random_weekly, table):
    models = {
        "LightGBM": trees.fit_model(table, "boosted", {"maxIter": 2}),
        "RandomForest": trees.fit_model(table, "forest", {"numTrees": 2}),
    }
    labels = random_weekly.select("establecimiento", "material", "cluster_label").distinct().filter("establecimiento <> 's0'")
    out = predict_next_week(random_weekly, labels, models).toPandas()
    assert len(out) == 24 and (out["predicted_volume"] >= 0).all()
    assert (out[out["establecimiento"] == "s0"]["model_type"] == "LightGBM (Default)").all()


def test_group_series(spark, random_weekly, tmp_path):
    found = group_series(random_weekly.drop("cluster_label"), k=3, output=str(tmp_path / "g"))
    assert found.weekly.count() == random_weekly.count()
    assert found.report().count() == 13 and "cluster_2" in found.report().columns
    assert found.distribution.agg(F.sum("pct")).first()[0] == pytest.approx(100)


def planted(n=260, noise=2.0):
    rng = np.random.default_rng(3)
    days = np.arange(n) * 7.0 + 9000
    promo = (rng.random(n) < 0.2).astype(float)
    y = (60 + 0.05 * np.arange(n)) * (1 + 0.4 * promo) + 12 * np.sin(2 * np.pi * days / 365.25)
    return days, y + rng.normal(0, noise, n), np.column_stack([promo, np.zeros(n)])


@pytest.mark.parametrize("multiplicative", [False, True])
def test_additive_model_recovers_what_was_planted(multiplicative):
    days, y, events = planted()
    model = additive.fit(days[:200], y[:200], events[:200], np.array([0.05]), np.array([10.0]), multiplicative)
    assert model.events[0] == pytest.approx([0.4, 0.0], abs=0.05)
    found = model.predict(days, events)
    assert np.abs(found["yhat"][0, 200:] - y[200:]).mean() < 5
    inside = (y[:200] >= found["yhat_lower"][0, :200]) & (y[:200] <= found["yhat_upper"][0, :200])
    assert 0.9 < inside.mean() <= 1


def test_batched_scales_equal_single_fits():
    days, y, events = planted(150)
    bends, seasons = np.array([0.01, 0.5]), np.array([0.1, 10.0])
    both = additive.fit(days, y, events, bends, seasons).predict(days, events)["yhat"]
    for i in range(2):
        one = additive.fit(days, y, events, bends[i : i + 1], seasons[i : i + 1]).predict(days, events)["yhat"][0]
        assert np.abs(one - both[i]).max() < 1e-6


@pytest.mark.parametrize("multiplicative", [False, True])
def test_histories_solved_together_equal_single_fits(multiplicative):
    days, y, events = planted(150)
    events[120:, 1] = 1  # varies in some of the histories only
    histories = [(days[:n], y[:n], events[:n]) for n in (150, 138, 100, 60, 12, 3)]
    bends, seasons = np.array([0.01, 0.5]), np.array([0.1, 10.0])
    many = additive.fit_many(histories, bends, seasons, multiplicative)
    for history, model in zip(histories, many, strict=True):
        one = additive.fit(*history, bends, seasons, multiplicative)
        assert model.predict(days, events)["yhat"] == pytest.approx(one.predict(days, events)["yhat"], rel=1e-6, abs=1e-6)
        assert list(model.converged) == list(one.converged)


def test_a_fit_without_enough_rounds_says_so(monkeypatch):
    days, y, events = planted(150)
    monkeypatch.setattr(additive, "ROUNDS", 1)
    assert not additive.fit(days, y, events, np.array([0.05]), np.array([10.0])).converged.any()
    monkeypatch.setattr(additive, "ROUNDS", 300)
    assert additive.fit(days, y, events, np.array([0.05]), np.array([10.0])).converged.all()


def test_forecast_statuses(weekly):
    days, y, events = planted(60)
    series = {
        ("a", "good"): [(i, float(v), int(p)) for i, (v, p) in enumerate(zip(y, events[:, 0]))],
        ("a", "short"): [(i, 1.0) for i in range(11)],
        ("a", "bad"): [(i, float("nan")) for i in range(30)],
        ("a", "zero"): [(i, 0.0) for i in range(30)],
    }
    out = fc.forecast(weekly(series), 12).cache()
    status = {r["material"]: r["status"] for r in out.select("material", "status").distinct().collect()}
    assert status["good"] == status["zero"] == "ok" and status["short"] == "skipped" and status["bad"] == "failed"
    assert out.filter("status = 'ok'").filter("converged is null").isEmpty()
    ahead = out.filter("material = 'good' and is_future").orderBy("ds").collect()
    assert [r["ds"] for r in ahead] == [week(60 + i) for i in range(12)]
    meta = {r["material"]: r for r in fc.model_metadata(out).collect()}
    assert meta["good"]["series_id"] == "a_good" and meta["good"]["start_date"] == str(week(0))
    assert meta["short"]["params"]["k"] is None and meta["short"]["data_points"] == 11


def test_backtest_and_grid(weekly):
    _, y, events = planted(130)
    df = weekly({("a", "x"): [(i, float(v), int(p)) for i, (v, p) in enumerate(zip(y, events[:, 0]))], ("a", "s"): [(i, 1.0) for i in range(40)]})
    rows = fc.backtest(df).cache()
    good = rows.filter("status = 'ok'")
    cut = split.backtest_cutoffs(df).select("establecimiento", "material", "cutoff")
    assert good.select("establecimiento", "material", "cutoff").distinct().exceptAll(cut).count() == 0
    assert good.count() == 12 * cut.count()
    assert good.filter("horizon_weeks <> datediff(ds, cutoff) / 7").count() == 0
    assert rows.filter("material = 's'").first()["status"] == "skipped"
    grid = {"seasonality_mode": ["additive"], "changepoint_prior_scale": [0.05, 0.5], "seasonality_prior_scale": [10.0]}
    tried = fc.grid_search(df, grid)
    assert tried.filter("status = 'ok'").count() == 2
    assert [r["rmse"] for r in tried.filter("material = 's' and status = 'skipped'").collect()] == [None]
    plain = good.groupBy("horizon_weeks").agg(F.sqrt(F.avg((F.col("y") - F.col("yhat")) ** 2)).alias("e"))
    want = plain.agg(F.avg("e")).first()[0]
    assert tried.filter("changepoint_prior_scale = 0.05").first()["rmse"] == pytest.approx(want, rel=1e-6)
    best = results.best_params(tried.filter("status = 'ok'"), "rmse", ["establecimiento", "material"], list(grid)).first()
    assert best["rmse"] == tried.agg(F.min("rmse")).first()[0]


def test_runs_can_be_continued(spark, weekly, tmp_path):
    _, y, events = planted(110)
    series = {("a", f"m{j}"): [(i, float(v) + j, int(p)) for i, (v, p) in enumerate(zip(y, events[:, 0]))] for j in range(3)}
    series[("a", "short")] = [(i, 1.0) for i in range(5)]
    df, out = weekly(series).cache(), str(tmp_path / "out")
    first = run_forecasts(df, out, top_n=1)
    assert first.results.count() == 1
    second = run_forecasts(df, out)
    assert second.results.count() == 4
    kept = first.results.select("series_id", "rmse").collect()[0]
    assert second.results.filter(F.col("series_id") == kept["series_id"]).first()["rmse"] == kept["rmse"]
    third = run_forecasts(df, out)
    assert third.forecasts.count() == second.forecasts.count() == 3 * (110 + 12)
    assert third.summary.first()["successful_models"] == 3
    assert third.totals.first()["included_series"] == 3
    again = run_forecasts(df, out, resume=False)
    assert again.results.count() == 4 and again.forecasts.count() == third.forecasts.count()
    assert read_results(spark, str(tmp_path / "nothing")) is None
