"""Group the series and put their labels on the weekly rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from weekloom.operators.clean import bad_values
from weekloom.operators.cluster import Clusters, attach_labels, centroid_report
from weekloom.operators.describe import label_distribution, series_features
from weekloom.operators.scale import Scaler
from weekloom.session import stage
from weekloom.settings import CLUSTER_COUNT, SEED, SERIES_FEATURES
from weekloom.sources.tables import write_by_label, write_csv
from weekloom.spec import DEFAULT, SeriesSpec


@dataclass
class Grouping:
    weekly: DataFrame
    labels: DataFrame
    scaler: Scaler
    clusters: Clusters

    @property
    def distribution(self) -> DataFrame:
        return label_distribution(self.weekly)

    def report(self) -> DataFrame:
        """Centroids in the original units, features as rows."""
        table = self.clusters.table(self.weekly.sparkSession)
        return centroid_report(table, range(len(self.clusters.centroids)), scaler=self.scaler)


def group_series(
    weekly: DataFrame,
    k: int = CLUSTER_COUNT,
    seed: int = SEED,
    output: str | None = None,
    spec: SeriesSpec = DEFAULT,
) -> Grouping:
    """Describe, scale and cluster the series; with ``output`` everything is also written there."""
    spark = weekly.sparkSession
    described = stage(series_features(weekly, spec).select(*spec.keys, *SERIES_FEATURES))
    broken = [c for c, bad in bad_values(described, SERIES_FEATURES).first().asDict().items() if bad]
    if broken:
        raise ValueError(f"NaN or infinite features: {', '.join(broken)}")
    scaler = Scaler.fit(described, SERIES_FEATURES)
    scaled = scaler.transform(described)
    clusters = Clusters.fit(scaled, k, seed, spec)
    labels = clusters.assign(scaled, spec).select(*spec.keys, spec.label)
    labelled = attach_labels(weekly, labels, spec)
    if output:
        scaler.save(spark, f"{output}/scaler")
        clusters.save(spark, f"{output}/centroids")
        labels.write.mode("overwrite").parquet(f"{output}/labels")
        write_by_label(labelled, f"{output}/weekly", spec)
        labelled = spark.read.schema(labelled.schema).parquet(f"{output}/weekly").select(*labelled.columns)
    grouping = Grouping(labelled, labels, scaler, clusters)
    if output:
        write_csv(grouping.report().coalesce(1), f"{output}/centroid_report")
    return grouping
