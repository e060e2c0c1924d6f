from weekloom.operators import cluster


def test_series_without_a_label_get_minus_one(spark):
    weekly = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "x", 3.0), ("c", "y", 4.0)], "establecimiento string, material string, weekly_volume double")
    labels = spark.createDataFrame([("a", "x", 0), ("c", "x", 2)], "establecimiento string, material string, cluster_label int")
    got = cluster.attach_labels(weekly, labels).select("establecimiento", "weekly_volume", "cluster_label").collect()
    assert sorted(map(tuple, got)) == [("a", 1.0, 0), ("a", 2.0, 0), ("b", 3.0, -1), ("c", 4.0, -1)]
    alone = cluster.attach_labels(weekly, labels.limit(0)).collect()
    assert len(alone) == 4 and {r.cluster_label for r in alone} == {-1}
