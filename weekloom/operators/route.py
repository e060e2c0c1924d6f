"""Which model answers for which series."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions.numeric import clamp
from weekloom.operators.results import union_all
from weekloom.settings import DEFAULT_ROUTE, ROUTES
from weekloom.spec import DEFAULT, SeriesSpec


def with_route(df: DataFrame, routes: Mapping[int, str] = ROUTES, default: str = DEFAULT_ROUTE, spec: SeriesSpec = DEFAULT):
    """Add the model type of the row's cluster; unknown and missing clusters take the default."""
    chosen = F.lit(default)
    for label, name in routes.items():
        chosen = F.when(F.col(spec.label) == label, F.lit(name)).otherwise(chosen)
    return df.withColumn("model_type", chosen)


def predict_routed(
    rows: DataFrame,
    models: Mapping[str, PipelineModel],
    routes: Mapping[int, str] = ROUTES,
    default: str = DEFAULT_ROUTE,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Predict all rows, each with the model of its cluster; ``models`` is keyed by the first word of the type.

    The table is scanned once per model, with the filter on the cluster in front. Rows without a model keep their type and
    get no prediction; ``status`` tells them apart.
    """
    routed = with_route(rows, routes, default, spec)
    family = F.split("model_type", " ").getItem(0)
    parts = []
    for name, model in models.items():
        scored = model.transform(routed.filter(family == name))
        parts.append(
            scored.select(
                *spec.keys,
                spec.time,
                spec.label,
                "model_type",
                clamp(F.col("prediction")).alias("predicted_volume"),
                F.lit("ok").alias("status"),
            )
        )
    rest = routed.filter(~F.coalesce(family.isin(list(models)), F.lit(False)))
    parts.append(
        rest.select(
            *spec.keys,
            spec.time,
            spec.label,
            "model_type",
            F.lit(None).cast("double").alias("predicted_volume"),
            F.lit("no model").alias("status"),
        )
    )
    return union_all(parts)
