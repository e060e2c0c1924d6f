"""Every series of a stack has a status, also one that no row of it can be used of."""

from pyspark.sql import functions as F

from weekloom.operators import clean, stack
from weekloom.operators.features import lag_features


def test_short_series_are_named(spark, weekly):
    table = weekly({("a", "long"): [(i, 1.0 + i) for i in range(60)], ("a", "short"): [(i, 2.0) for i in range(20)]})
    rows = lag_features(table, [4, 52])
    got = {r.material: (r.weeks, r.usable_weeks, r.status) for r in stack.series_status(rows).collect()}
    assert got == {"long": (60, 8, "ok"), "short": (20, 0, "short history")}
    used = {r.material: r["count"] for r in stack.prepare(rows).groupBy("material").count().collect()}
    assert used == {"long": 8}
    assert stack.series_status(rows.limit(0)).count() == 0


def test_complete_means_what_drop_incomplete_keeps(spark):
    rows = [(1, 1.0, 1), (2, None, 1), (3, float("nan"), 1), (4, 2.0, None), (5, 0.0, 0)]
    df = spark.createDataFrame(rows, "id int, volume_lag_1 double, days_since_last_sale int").withColumn("other", F.lit(None).cast("int"))
    kept = [r.id for r in df.filter(clean.is_complete(df)).collect()]
    assert kept == [r.id for r in clean.drop_incomplete(df).collect()] == [1, 5]
    assert df.select("id").filter(clean.is_complete(df.select("id"))).count() == 5
