import os

from pyspark.sql import functions as F

from weekloom.operators import results
from weekloom.sources import tables as tb
from weekloom.spec import FORECAST, SERIES_LABELS


def test_label_folders_are_pruned(spark, random_weekly, tmp_path):
    path = str(tmp_path / "w")
    tb.write_by_label(random_weekly, path)
    one = tb.read_label(spark, path, 1)
    assert one.count() == random_weekly.filter("cluster_label = 1").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_label" in plan


def test_replacing_one_label_keeps_the_others(random_weekly, spark, tmp_path):
    path = str(tmp_path / "w")
    tb.replace_labels(random_weekly, path)
    tb.replace_labels(random_weekly.filter("cluster_label = 1").limit(5), path)
    sizes = {r["cluster_label"]: r["count"] for r in spark.read.parquet(path).groupBy("cluster_label").count().collect()}
    assert sizes[1] == 5 and sizes[0] == random_weekly.filter("cluster_label = 0").count()


def test_column_lists_reach_the_scan(spark, random_weekly, tmp_path):
    path = str(tmp_path / "w")
    tb.write_parquet(random_weekly, path, "zstd")
    plan = tb.read_parquet(spark, path, ["week"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<week:date>" in plan
    assert any(".zstd." in f for f in os.listdir(path))
    assert tb.read_schema(spark, path) == spark.read.parquet(path).schema


def test_csv_and_json(spark, tmp_path):
    labels = spark.createDataFrame([("a", "x", 1), ("b", "y", None)], SERIES_LABELS)
    tb.write_csv(labels, str(tmp_path / "c"))
    tb.write_csv(labels, str(tmp_path / "c"), "append")
    assert tb.read_csv(spark, str(tmp_path / "c"), SERIES_LABELS).count() == 4
    nested = labels.withColumn("evaluation", F.struct(F.lit(1.5).alias("rmse"), F.lit(None).cast("double").alias("mape")))
    tb.write_json(nested, str(tmp_path / "j"))
    back = tb.read_json(spark, str(tmp_path / "j"), nested.schema)
    assert back.exceptAll(nested).count() == 0


def test_forecast_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", None, 1.0, 0.5, 1.5, 1.0, 0.0)], FORECAST).withColumn("extra", F.lit(1))
    tb.write_forecasts(rows, str(tmp_path / "f"))
    assert set(spark.read.parquet(str(tmp_path / "f")).columns) == set(FORECAST.names)


def test_registered_table(spark, random_weekly):
    tb.register(random_weekly, "weekly_rows")
    assert spark.sql("SELECT count(*) FROM weekly_rows").first()[0] == random_weekly.count()


def test_param_grid(spark):
    grid = results.param_grid(spark)
    assert grid.count() == 32 and grid.select("param_id").distinct().count() == 32


def test_newest_result_wins(spark):
    old = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "establecimiento string, material string, rmse double")
    new = spark.createDataFrame([("a", "y", 9.0), ("b", "z", 3.0)], old.schema)
    out = {(r[0], r[1]): r[2] for r in results.merge_results(old, new).collect()}
    assert out == {("a", "x"): 1.0, ("a", "y"): 9.0, ("b", "z"): 3.0}


def test_series_id_with_separator_in_item(spark):
    df = spark.createDataFrame([("12", "a_b")], "establecimiento string, material string")
    back = results.split_series_id(results.series_id(df).select("series_id")).first()
    assert (back["establecimiento"], back["material"]) == ("12", "a_b")
