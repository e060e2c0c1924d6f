"""Groups of similar series."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.lookup import LOOKUP_ROWS, bounded, lookup_join
from weekloom.operators.scale import Scaler
from weekloom.session import in_parallel
from weekloom.settings import CLUSTER_COUNT, CLUSTER_SWEEP, SEED, SERIES_FEATURES
from weekloom.spec import DEFAULT, SeriesSpec, feature_columns

POINTS_A_TASK = 20_000


def _vectors(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="__point", handleInvalid="error").transform(df)


def cluster_columns(df: DataFrame, spec: SeriesSpec = DEFAULT) -> list[str]:
    """Every column of the table but the keys and the label."""
    return feature_columns(df, [*spec.keys, spec.label])


def sweep(
    scaled: DataFrame,
    ks: Iterable[int] = CLUSTER_SWEEP,
    seed: int = SEED,
    threads: int = 9,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Inertia and silhouette for several numbers of clusters; one row per number.

    The silhouette uses squared Euclidean distance: with it the mean distance to a cluster follows from sums
    over the cluster, so that no pairs of series are formed.
    """
    points = _vectors(scaled, cluster_columns(scaled, spec)).select("__point")
    parts = -(-points.count() // POINTS_A_TASK) or 1  # few points in many partitions cost only task starts
    points = points.coalesce(parts).persist()

    def one(k: int) -> tuple[int, float, float]:
        model = KMeans(k=k, seed=seed, featuresCol="__point").fit(points)
        judge = ClusteringEvaluator(featuresCol="__point", predictionCol="prediction")
        return k, float(model.summary.trainingCost), float(judge.evaluate(model.transform(points)))

    try:
        rows = in_parallel(scaled.sparkSession, [lambda k=k: one(k) for k in ks], threads)
    finally:
        points.unpersist()
    return scaled.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


@dataclass(frozen=True)
class Clusters:
    """Fitted centroids with labels by falling centroid volume, so that a label keeps its meaning between runs."""

    columns: list[str]
    centroids: list[list[float]]

    @staticmethod
    def fit(
        scaled: DataFrame, k: int = CLUSTER_COUNT, seed: int = SEED, spec: SeriesSpec = DEFAULT
    ) -> Clusters:
        columns = cluster_columns(scaled, spec)
        points = _vectors(scaled, columns).select("__point").persist()
        try:
            model: KMeansModel = KMeans(k=k, seed=seed, featuresCol="__point").fit(points)
        finally:
            points.unpersist()
        centroids = [[float(x) for x in c] for c in model.clusterCenters()]
        first = columns.index("total_liters") if "total_liters" in columns else 0
        return Clusters(columns, sorted(centroids, key=lambda c: (-c[first], c)))

    def assign(self, scaled: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
        return assign_nearest(scaled, self.columns, self.centroids, spec)

    def table(self, spark: SparkSession) -> DataFrame:
        schema = "cluster_label int, " + ", ".join(f"`{c}` double" for c in self.columns)
        return spark.createDataFrame([(i, *c) for i, c in enumerate(self.centroids)], schema)

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Clusters:
        df = spark.read.parquet(path)
        rows = sorted(df.collect(), key=lambda r: r["cluster_label"])
        columns = [c for c in df.columns if c != "cluster_label"]
        return Clusters(columns, [[r[c] for c in columns] for r in rows])


def assign_nearest(
    df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]], spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Label of the nearest centroid (the first of equally near ones), as a plain expression."""
    distances = []
    for centre in centroids:
        parts = [(F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, centre, strict=True)]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        distances.append(total)
    gathered = df.withColumn("__d", F.array(*distances))
    nearest = F.array_position("__d", F.array_min("__d")) - 1
    return gathered.withColumn(spec.label, nearest.cast("int")).drop("__d")


def attach_labels(weekly: DataFrame, labels: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Weekly rows with the label of their series, -1 for series without one.

    There may be as many labels as series, so the join is left to Spark: both sides are hashed by series.
    """
    joined = weekly.join(labels.select(*spec.keys, spec.label), spec.key_list, "left")
    return joined.withColumn(spec.label, F.coalesce(spec.label, F.lit(-1)))


def silhouette(
    df: DataFrame, columns: Sequence[str], spec: SeriesSpec = DEFAULT
) -> DataFrame:
    """Mean squared-Euclidean silhouette of given labels, overall as one row.

    The mean squared distance of a point x to a cluster is |x|^2 - 2 x.m + s, with the cluster's mean m and mean
    squared length s: one small row per cluster instead of all pairs.
    """
    square = _dot([F.col(c) for c in columns], [F.col(c) for c in columns])
    moments = df.groupBy(spec.label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(square).alias("s"), *[F.avg(c).alias(f"m_{c}") for c in columns]
    )
    local = bounded(moments)
    if local is None:
        raise ValueError(f"more than {LOOKUP_ROWS} labels")
    found = sorted(local.collect(), key=lambda r: r[spec.label])
    own, other = [], []
    for r in found:
        far = square - F.lit(2.0) * _dot([F.col(c) for c in columns], [F.lit(r[f"m_{c}"]) for c in columns]) + F.lit(r["s"])
        mine = F.col(spec.label) == r[spec.label]
        # The point itself is not among the others of its cluster.
        own.append(F.when(mine, far * F.lit(r["n"] / (r["n"] - 1) if r["n"] > 1 else 0.0)))
        other.append(F.when(~mine, far))
    single = [r[spec.label] for r in found if r["n"] == 1]
    a, b = F.coalesce(*own), F.array_min(F.array_compact(F.array(*other)))
    distances = df.select(spec.label, a.alias("a"), b.alias("b"))
    score = F.when(F.col(spec.label).isin(single), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return distances.agg(F.avg(score).alias("silhouette"), F.count(F.lit(1)).alias("series_count"))


def _dot(left, right):
    total = left[0] * right[0]
    for x, y in zip(left[1:], right[1:], strict=True):
        total = total + x * y
    return total


def cluster_means(labelled: DataFrame, columns: Sequence[str], spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Mean feature vector and number of series per label."""
    return labelled.groupBy(spec.label).agg(
        F.count(F.lit(1)).alias("series_count"), *[F.avg(c).alias(c) for c in columns]
    )


def centroid_report(
    centroids: DataFrame,
    labels: Sequence[int],
    names: Mapping[str, str] = SERIES_FEATURES,
    scaler: Scaler | None = None,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Features as rows with readable names, clusters as columns; with a scaler in the original units."""
    table = scaler.inverse(centroids) if scaler else centroids
    columns = [c for c in centroids.columns if c in names]
    long = table.select(spec.label, *[F.col(c).cast("double") for c in columns]).unpivot(
        [spec.label], columns, "feature", "value"
    )
    wide = long.groupBy("feature").pivot(spec.label, list(labels)).agg(F.first("value"))
    titles = centroids.sparkSession.createDataFrame(
        [(i, c, names[c]) for i, c in enumerate(columns)], "place int, feature string, description string"
    )
    return lookup_join(wide, titles, ["feature"], "inner").select(
        "place", "feature", "description", *[F.col(str(x)).alias(f"cluster_{x}") for x in labels]
    )
