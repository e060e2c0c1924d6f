"""The stacks per cluster run with the folds, trees and patience of the operator, and trees are counted with few fits."""

import inspect

from pyspark.ml.linalg import VectorUDT, Vectors
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from catalog import queries
from weekloom import settings
from weekloom.operators import stack


def test_query_of_stacks_per_cluster_takes_the_whole_job(spark, monkeypatch):
    took, table = {}, spark.createDataFrame([(1, "a")], "cluster_label int, status string")
    signature = inspect.signature(stack.stack_clusters)

    def spy(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        took.update(bound.arguments)
        return None, table

    monkeypatch.setattr(stack, "stack_clusters", spy)
    monkeypatch.setattr(queries.t, "model_table", lambda *_: table)
    assert queries.QUERIES["stacking_by_cluster"](spark, "").collect() == table.collect()
    assert took["table"] is table and took["max_rows"] is None and took["done"] is None
    assert took["folds"] == settings.CV_FOLDS_CLUSTER == 3
    assert took["params"] == settings.STACK_BASE_CLUSTER and took["params"]["maxIter"] == 1000
    assert took["params"]["maxIter"] > 2 * settings.STACK_PATIENCE  # else the patience could never end a fit
    assert took["test_weeks"] == settings.TEST_WEEKS


def test_trees_are_counted_as_in_one_fit_to_the_limit(spark, monkeypatch):
    fields = [StructField("y", DoubleType()), StructField("x", VectorUDT()), StructField("__held", BooleanType())]
    rows = [(float(i % 7 * 10 + i % 3), Vectors.dense(i % 7, i % 5), i % 4 == 0) for i in range(200)]
    points = spark.createDataFrame(rows, StructType(fields)).coalesce(1).cache()
    params = {"featuresCol": "x", "labelCol": "y", "lossType": "absolute", "maxDepth": 2, "stepSize": 0.5, "maxIter": 40, "seed": 3}
    whole = stack.GBTRegressor(**params).fit(points.filter(~F.col("__held")))
    losses = whole.evaluateEachIteration(points.filter("__held"), "absolute")
    fitted, real = [], stack.GBTRegressor
    monkeypatch.setattr(stack, "GBTRegressor", lambda **p: fitted.append(p["maxIter"]) or real(**p))
    for patience in (2, 4):
        fitted.clear()
        assert stack._tree_count(points, params, patience) == stack.best_prefix(losses, patience)
        steps = [2 * patience * 4**i for i in range(4)]
        assert fitted == [min(n, 40) for n in steps][: len(fitted)] and len(fitted) > 1
