"""Encodings and medians in the order of time, what a cutoff may see, recursive forecasts, manifests, exact samples."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import week
from pyspark.errors import PySparkException
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from weekloom.operators import asof, lookup, sampling, scale, split, target_stats, trees
from weekloom.plans import batch_forecast
from weekloom.plans.inference import predict_next_week, roll_forward


def jobs_of(spark, work):
    """The number of Spark jobs that ``work`` starts."""
    context, name = spark.sparkContext, f"jobs-{random.random()}"
    context.setJobGroup(name, name)
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_plans_start_no_job(spark, random_weekly):
    df = random_weekly.withColumn("fold", F.lit(1))
    work = [
        lambda: split.positional_split(df),
        lambda: split.chronological_split(df),
        lambda: split.week_share_split(df),
        lambda: split.cv_folds(df.drop("fold")),
        lambda: split.cv_folds(df.drop("fold"), mode="positional"),
        lambda: target_stats.ordered_target_statistics(df),
        lambda: target_stats.category_codes(df, "material"),
        lambda: scale.fold_medians(df, ["weekly_volume"], 3, ["cluster_label"]),
        lambda: scale.exact_medians(df, ["weekly_volume"]),
    ]
    assert [jobs_of(spark, w) for w in work] == [0] * len(work)
    assert jobs_of(spark, lambda: split.positional_split(df).count()) > 0


def test_prefix_totals_of_every_kind_of_number(spark):
    rng = np.random.default_rng(2)
    values = [0.0, -0.5, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, 1.0, 2.0, 4.0, 8.0, math.nextafter(8.0, 0)]
    values += list(rng.normal(0, 1, 300)) + list(1000 + rng.random(300)) + list(2.0 ** rng.integers(-1060, 1000, 200).astype(float))
    values = sorted(set(values))
    rows = [(g, float(v), int(rng.integers(1, 5))) for g in ("a", None) for v in values]
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(5)
    out = lookup.prefix_totals(df, ["g"], ["v"], {"n": F.col("n"), "one": F.lit(1)}, lookup.number_levels("v"))
    for g in ("a", None):
        part = sorted((r for r in out.collect() if r.g == g), key=lambda r: r.v)
        n = np.array([r.n for r in part])
        assert [r.n_before for r in part] == (np.cumsum(n) - n).tolist()
        assert [r.one_before for r in part] == list(range(len(part)))
        assert {(r.n_total, r.one_total) for r in part} == {(int(n.sum()), len(part))}


def test_a_hot_label_spreads_over_its_series(spark):
    """Windows over one label's series are cut by the first key, so no window holds the label."""
    rows = [(f"s{i % 40:02d}", f"m{i // 40:03d}", week(0), 1.0, 0, 0, 7) for i in range(2000)]
    schema = "establecimiento string, material string, week date, weekly_volume double, has_promo int, is_covid_period int, cluster_label int"
    df = spark.createDataFrame(rows, schema)
    out = split.positions(df).toPandas().sort_values(["establecimiento", "material"])
    assert out["pos"].tolist() == list(range(2000)) and set(out["group_rows"]) == {2000}
    plan = split.positions(df)._jdf.queryExecution().toString()
    assert "__level_1" in plan and "Scan ExistingRDD[__block" not in plan


def test_fold_medians_of_prefixes(spark):
    rng = np.random.default_rng(6)
    data = [(int(c), int(f), float(v), float(w)) for c, f, v, w in zip(rng.integers(0, 2, 400), rng.integers(-1, 3, 400), rng.integers(0, 30, 400), rng.normal(0, 1, 400))]
    data += [(2, 2, math.nan, 1.0), (0, 0, -0.0, 2.0), (0, 1, None, None)]
    df = spark.createDataFrame(data, "cluster_label int, fold int, x double, y double").repartition(4)
    got = {(r.cluster_label, r.feature, r.fold): r["median"] for r in scale.fold_medians(df, ["x", "y"], 3, ["cluster_label"]).collect()}
    want = {}
    frame = pd.DataFrame(data, columns=["c", "fold", "x", "y"])
    for c in (0, 1, 2):
        for f in range(4):
            for name in "xy":
                own = frame[(frame.c == c) & (frame.fold < f)][name].dropna()
                if len(own):
                    want[(c, name, f)] = own.median()
    assert got == pytest.approx(want)


def test_medians_of_a_training_run_are_one_ordering(spark, random_weekly):
    df = split.cv_folds(random_weekly.withColumn("gap", F.when(F.col("weekly_volume") > 1, F.col("weekly_volume"))))
    df = df.cache()
    df.count()
    made = []
    jobs = jobs_of(spark, lambda: made.append(trees.cluster_medians(df, 5)))
    one = jobs_of(spark, lambda: trees.cluster_medians(df.filter("cluster_label = 0"), 1))
    assert jobs <= one + 1  # not one for each of 3 clusters and 6 prefixes
    frame = df.toPandas()
    for label, folds in made[0].items():
        for f, medians in folds.items():
            own = frame[(frame.cluster_label == label) & (frame.fold < f)]["gap"].dropna()
            assert medians == {"gap": own.median()}
    assert set(made[0]) == {0, 1, 2}


def plain_statistics(rows, keys, column, prior_rows=10.0):
    out = {}
    for i, r in enumerate(rows):
        earlier = [q for q in rows if q["week"] < r["week"] and all(q[k] == r[k] for k in keys) and q["weekly_volume"] is not None]
        prior = sum(q["weekly_volume"] for q in earlier) / len(earlier) if earlier else 0.0
        own = [q["weekly_volume"] for q in earlier if (q[column] or "missing") == (r[column] or "missing")]
        out[i] = (sum(own) + prior_rows * prior) / (len(own) + prior_rows)
    return out


def test_target_statistics_see_only_earlier_weeks(spark):
    rng = random.Random(4)
    rows = []
    for s in ("a", "b", None):
        for m in ("x", "y"):
            for w in sorted(rng.sample(range(20), 9)):
                rows.append((s, m, week(w), rng.choice([None, 1.0, 4.0, 9.0]), 0, 0, rng.choice([0, 1])))
    rows += [("new", "x", week(30), None, 0, 0, 0), ("a", "x", week(3), 5.0, 0, 0, None)]
    schema = "establecimiento string, material string, week date, weekly_volume double, has_promo int, is_covid_period int, cluster_label int"
    df = spark.createDataFrame(rows, schema).repartition(3)
    names = ["establecimiento", "material", "week", "weekly_volume", "has_promo", "is_covid_period", "cluster_label"]
    dicts = [dict(zip(names, r)) for r in rows]
    for column in ("establecimiento", "material"):
        want = sorted(zip(map(str, rows), plain_statistics(dicts, ["cluster_label"], column).values()))
        got = target_stats.ordered_target_statistics(df, [column]).collect()
        got = sorted((str(tuple(r[n] for n in names)), r[f"ts_{column}"]) for r in got)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want])
    # an unseen category has the prior; later targets change nothing before them
    changed = df.withColumn("weekly_volume", F.when(F.col("week") >= F.lit(week(10)), F.lit(1e9)).otherwise(F.col("weekly_volume")))
    before = F.col("week") <= F.lit(week(10))
    one, two = (target_stats.ordered_target_statistics(d).filter(before).drop("weekly_volume") for d in (df, changed))
    assert one.exceptAll(two).count() == 0 and target_stats.ordered_target_statistics(df.limit(0)).count() == 0


def test_statistics_of_rows_apart_from_their_history(random_weekly):
    start = F.col("week") >= F.lit(week(100))
    history, rows = random_weekly.filter(~start), random_weekly.filter(start)
    got = target_stats.statistics_for(rows, history).collect()
    whole = random_weekly.withColumn("known", ~start).withColumn("weekly_volume", F.when(~start, F.col("weekly_volume")))
    want = target_stats.ordered_target_statistics(whole).filter(start).collect()
    plain = lambda r: (r.establecimiento, r.material, r.week, round(r.ts_establecimiento, 9), round(r.ts_material, 9))
    assert sorted(map(plain, got)) == sorted(map(plain, want)) and {r.weekly_volume for r in got} - {None}


def test_many_categories_need_no_dictionary(spark):
    many = spark.range(200_000).selectExpr("cast(id AS string) AS establecimiento", "cast(id % 7 AS string) AS material",
        "date_add(date'2020-01-06', cast(7 * (id % 50) AS int)) AS week", "cast(id % 11 AS double) AS weekly_volume", "0 AS has_promo",
        "0 AS is_covid_period", "0 AS cluster_label")
    codes = target_stats.category_codes(many, "establecimiento")
    facts = codes.agg(F.count("*"), F.min("code"), F.max("code"), F.countDistinct("code")).first()
    assert tuple(facts) == (200_000, 0, 199_999, 200_000)
    table = target_stats.ordered_target_statistics(many)
    encoder, bins = trees.fit_encoder(table, ["ts_establecimiento", "ts_material"], ["establecimiento", "material"], "target", medians={})
    assert bins == 32 and encoder.transform(table).count() == 200_000
    assert "StringIndexer" not in str(encoder.stages)
    assert target_stats.with_codes(spark.createDataFrame([("9",), ("none",), (None,)], "c string"), codes, "c", "code").filter("code = -1").count() == 2


def facts(spark):
    rows = [("a", "x", week(i), float(i), week(i - 2)) for i in range(10)] + [("a", "x", week(8), 80.0, week(7)), ("a", None, week(1), 5.0, week(0))]
    return spark.createDataFrame(rows, "establecimiento string, material string, week date, v double, since date")


def test_regressors_as_known_at_the_cutoff(spark):
    frame = [("a", "x", week(8), week(5)), ("a", "x", week(8), week(6)), ("a", "x", week(8), week(7)), ("a", "x", week(3), week(5)),
        ("a", "x", None, week(5)), ("a", "x", week(8), None), ("b", "x", week(8), week(9)), ("a", "x", week(8), week(7))]
    frame = spark.createDataFrame(frame, "establecimiento string, material string, ds date, cutoff date")
    got = asof.planned_regressors(frame, facts(spark), ["v"], "since", fill=-1)
    seen = sorted(((r.ds, r.cutoff, r.v, r.is_known) for r in got.collect()), key=str)
    want = [(week(8), week(5), -1.0, False), (week(8), week(6), 8.0, True), (week(8), week(7), 80.0, True), (week(8), week(7), 80.0, True),
        (week(3), week(5), 3.0, True), (None, week(5), -1.0, False), (week(8), None, -1.0, False), (week(8), week(9), -1.0, False)]
    assert seen == sorted(want, key=str)
    # without a known_since a fact after the cutoff is never seen
    plain = asof.planned_regressors(frame, facts(spark), ["v"], fill=-1)
    assert {(r.ds, r.v) for r in plain.filter("ds > cutoff").collect()} == {(week(8), -1.0)}
    assert asof.planned_regressors(frame, facts(spark).limit(0), ["v"]).count() == 8


def test_last_known_and_planted_leaks(spark):
    frame = [("a", "x", week(8), week(5)), ("a", "x", week(3), week(5)), ("a", "x", week(0), week(-1)), ("a", "x", week(40), week(30)), ("c", "x", week(1), week(1)), ("a", "x", None, week(2))]
    frame = spark.createDataFrame(frame, "establecimiento string, material string, ds date, cutoff date").repartition(2)
    found = asof.last_known(frame, facts(spark).select("establecimiento", "material", "week", "v"), ["v"])
    got = {(r.establecimiento, r.ds, r.cutoff): (r.last_v, r.last_date) for r in found.collect()}
    assert got == {
        ("a", week(8), week(5)): (5.0, week(5)), ("a", week(3), week(5)): (3.0, week(3)), ("a", week(0), week(-1)): (None, None),
        ("a", week(40), week(30)): (9.0, week(9)), ("c", week(1), week(1)): (None, None), ("a", None, week(2)): (2.0, week(2)),
    }
    assert asof.leaks(found, "last_date").count() == 0 and asof.without_leaks(found, "last_date").collect() == found.collect()
    planted = found.withColumn("last_date", F.date_add("cutoff", 7))
    assert asof.leaks(planted, "last_date").count() == 6
    with pytest.raises(PySparkException, match="lies after the cutoff"):
        asof.without_leaks(planted, "last_date").collect()


FORMULA = (
    "0.6 * volume_lag_1 + 0.3 * volume_lag_4 + 0.05 * volume_roll_mean_8w + 2 * has_promo"
    " + 0.01 * days_since_last_sale + 0.5 * is_holiday_in_week"
)


@pytest.fixture(scope="module")
def models(spark):
    model = SQLTransformer(statement=f"SELECT *, {FORMULA} AS prediction FROM __THIS__")
    return {"LightGBM": model, "RandomForest": model}


def labels_of(df):
    return df.select("establecimiento", "material", "cluster_label").distinct()


def test_one_step_equals_next_week(random_weekly, models):
    labels = labels_of(random_weekly)
    one = roll_forward(random_weekly, labels, models, weeks=1).drop("step").collect()
    want = predict_next_week(random_weekly, labels, models).collect()
    assert sorted(map(str, one)) == sorted(map(str, want)) and len(one) == 24
    with pytest.raises(ValueError):
        roll_forward(random_weekly, labels, models)


def test_several_steps_equal_a_loop(spark, random_weekly, models):
    """Each step is the one-step prediction over a table to which the steps before were added by hand, in pandas."""
    labels = labels_of(random_weekly)
    promos = random_weekly.groupBy("establecimiento", "material").agg(F.date_add(F.max("week"), 14).alias("week")).withColumn("has_promo", F.lit(1))
    got = roll_forward(random_weekly, labels, models, weeks=3, promos=promos).toPandas()
    key = ["establecimiento", "material"]
    table = random_weekly.toPandas()
    for step in range(1, 4):
        frame = spark.createDataFrame(table, random_weekly.schema)
        last = promos.withColumn("week", F.date_sub("week", 0 if step == 2 else 700))
        one = roll_forward(frame, labels, models, weeks=1, promos=last).toPandas()
        mine = got[got.step == step].merge(one, on=[*key, "week"], suffixes=("", "_want"))
        assert len(mine) == len(one) == 24
        assert mine["predicted_volume"].tolist() == pytest.approx(mine["predicted_volume_want"].tolist())
        new = one.assign(weekly_volume=one["predicted_volume"], has_promo=int(step == 2), is_covid_period=0)
        table = pd.concat([table, new[list(random_weekly.columns)]])
    assert got["predicted_volume"].nunique() > 40


def test_until_a_date(random_weekly, models):
    """Ends that differ by up to two weeks, and a date that lies three weeks after the earliest one."""
    per_series = random_weekly.groupBy("establecimiento", "material").agg(F.max("week").alias("e"))
    least = per_series.agg(F.min("e")).first()[0]
    cut = random_weekly.filter(F.col("week") <= F.lit(least + dt.timedelta(weeks=2))).cache()
    ends = {(r.establecimiento, r.material): r.e for r in cut.groupBy("establecimiento", "material").agg(F.max("week").alias("e")).collect()}
    target = least + dt.timedelta(weeks=3, days=3)
    got = roll_forward(cut, labels_of(cut), {"LightGBM": models["LightGBM"]}, until=target, country="ES", region="CT").collect()
    weeks = {}
    for r in got:
        weeks.setdefault((r.establecimiento, r.material), []).append(r.week)
    want = {k: [e + dt.timedelta(weeks=i) for i in range(1, 1 + (target - e).days // 7)] for k, e in ends.items()}
    assert {k: sorted(v) for k, v in weeks.items()} == {k: v for k, v in want.items() if v}
    assert {r.status for r in got} == {"ok", "no model"}
    assert roll_forward(cut, labels_of(cut), models, until=dt.date(1990, 1, 1)).count() == 0


def test_a_broken_run_and_two_writers(spark, weekly, tmp_path):
    series = {("a", f"m{j}"): [(i, float((i * 7 + j) % 13)) for i in range(40)] for j in range(4)}
    df, out = weekly(series).cache(), str(tmp_path / "out")
    assert batch_forecast.manifest(spark, out) is None and batch_forecast.run_states(spark, out) is None
    first = batch_forecast.run_forecasts(df, out, top_n=1)
    # a run that wrote everything but its manifest row, and one that wrote its forecasts only
    for name in batch_forecast.TABLES:
        table = spark.read.parquet(f"{out}/{name}").drop("run")
        table.withColumn("material", F.lit("m9")).write.parquet(f"{out}/{name}/run=99999999999999999999-late")
    spark.read.parquet(f"{out}/forecasts").drop("run").write.parquet(f"{out}/forecasts/run=5-early")
    again = batch_forecast.read_results(spark, out)
    assert again.results.count() == 1 and again.forecasts.count() == first.forecasts.count()
    done = batch_forecast.run_forecasts(df, out)
    assert done.results.count() == 4 and done.results.filter("material = 'm9'").isEmpty()
    states = [r.state for r in batch_forecast.run_states(spark, out).orderBy("run").collect()]
    assert sorted(states) == ["complete", "complete", "unfinished", "unfinished"]
    # a second writer that started from the same state: its rows count where its run is the later one
    other = batch_forecast.run_forecasts(df, out, resume=False)
    assert other.results.count() == 4
    rows = batch_forecast.manifest(spark, out).orderBy("run").collect()
    assert [r.series for r in rows] == [1, 3, 4] and len({r.series_set for r in rows}) == 3
    run = rows[-1].run
    spark.read.parquet(f"{out}/results").filter(F.col("run") == run).drop("run").limit(1).write.mode("append").parquet(f"{out}/results/run={run}")
    assert {r.run: r.state for r in batch_forecast.run_states(spark, out).collect()}[run] == "damaged"


@pytest.mark.parametrize("rows", [0, 777, 5000])
def test_samples_of_one_group(spark, rows):
    df = spark.range(3000).selectExpr("cast(id AS string) AS establecimiento", "'m' AS material", "date'2020-01-06' AS week")
    want = {r.establecimiento for r in df.withColumn("h", sampling.portable_hash(["establecimiento", "material", "week"], sampling.SEED)).orderBy("h").limit(rows).collect()}
    for ordered in (10_000, 0):  # the smaller the bound, the more digits are used
        got = [r.establecimiento for r in sampling.sample_rows(df, rows, group=[], ordered=ordered).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_samples_of_equal_keys(spark):
    df = spark.range(500).selectExpr("'s' AS establecimiento", "'m' AS material", "date'2020-01-06' AS week", "id")
    assert sampling.sample_rows(df, 100, group=[], ordered=5).count() == 100
    assert sampling.sample_rows(df.limit(0), 100, group=[]).count() == 0
