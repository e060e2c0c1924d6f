"""Predict the weeks after the end of every series with the model its cluster is routed to."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.cluster import attach_labels
from weekloom.operators.features import next_week_features
from weekloom.operators.results import union_all
from weekloom.operators.route import predict_routed
from weekloom.operators.target_stats import statistics_for
from weekloom.session import stage
from weekloom.settings import DEFAULT_ROUTE, LAGS, ROLLING_WINDOWS, ROUTES
from weekloom.spec import DEFAULT, SeriesSpec


def predict_next_week(
    weekly: DataFrame,
    labels: DataFrame,
    models: Mapping[str, PipelineModel],
    promo: int = 0,
    period: int = 0,
    holidays: DataFrame | None = None,
    routes: Mapping[int, str] = ROUTES,
    default: str = DEFAULT_ROUTE,
    spec: SeriesSpec = DEFAULT,
    country: str = "ES",
    region: str | None = None,
    statistics: bool = False,
) -> DataFrame:
    """One row per series: predicted volume, model type and cluster. Features before the start of a series are 0.

    ``statistics`` adds the target statistics of the keys, which models trained with ``mode="target"`` need.
    """
    labelled = attach_labels(weekly.drop(spec.label), labels, spec)
    rows = next_week_features(labelled, 1, promo, period, holidays, country, region, spec=spec)
    if statistics:
        rows = statistics_for(rows, labelled, spec=spec)
    return predict_routed(_filled(rows), models, routes, default, spec)


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in rows.columns if "lag_" in c})


def _tail(labelled: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The rows that a feature can reach, and the last one with a sale, which may lie further back."""
    reach = max([*LAGS, *ROLLING_WINDOWS, 7])
    sale = F.when(F.col(spec.value) > 0, F.col(spec.time))
    back = F.row_number().over(spec.by_series().orderBy(F.col(spec.time).desc()))
    marked = labelled.withColumns({"__back": back, "__sale": F.max(sale).over(spec.by_series())})
    return marked.filter((F.col("__back") <= reach) | (F.col(spec.time) == F.col("__sale"))).drop("__back", "__sale")


def roll_forward(
    weekly: DataFrame,
    labels: DataFrame,
    models: Mapping[str, PipelineModel],
    weeks: int | None = None,
    until: dt.date | None = None,
    promos: DataFrame | None = None,
    period: int = 0,
    holidays: DataFrame | None = None,
    country: str = "ES",
    region: str | None = None,
    routes: Mapping[int, str] = ROUTES,
    default: str = DEFAULT_ROUTE,
    spec: SeriesSpec = DEFAULT,
    statistics: bool = False,
) -> DataFrame:
    """Predictions of several weeks, each week predicted from the weeks before it, predicted ones included.

    Either ``weeks`` weeks after the end of every series, or every week up to the date ``until`` (series that end later have
    none). Columns: keys, date, step (from 1), label, model_type, predicted_volume and status. ``promos`` has the planned
    promotions (keys, date, flag); weeks without one have none. A series whose cluster has no model gets rows without a
    prediction; its lags see 0 there. ``statistics`` adds the target statistics of the keys at the end of the actual history,
    which models trained with ``mode="target"`` need.

    All series take a step together, in one plan whose history is the rows that features can reach. A step writes its
    feature rows, which every model reads, and its predictions to the shared folder, so a lost executor repeats one
    step, and plans do not grow with the horizon.
    """
    if (weeks is None) == (until is None):
        raise ValueError("either weeks or until")
    labelled = attach_labels(weekly.drop(spec.label), labels, spec)
    history = stage(_tail(labelled, spec))
    if until is not None:
        last = history.groupBy(*spec.keys).agg(F.max(spec.time).alias("t"))
        gap = last.agg(F.max(F.floor(F.datediff(F.lit(until), "t") / 7))).first()[0]
        weeks = max(0, gap or 0)
    kinds, done = dict(labelled.dtypes), []
    for step in range(1, weeks + 1):
        if until is not None:
            ends = F.max(spec.time).over(spec.by_series())
            history = history.withColumn("__end", ends).filter(F.date_add("__end", 7) <= F.lit(until)).drop("__end")
        if promos is not None:
            history = _next_promo(history, promos, spec)
        promo = F.col("__promo") if promos is not None else 0
        rows = next_week_features(history, 1, promo, period, holidays, country, region, spec=spec)
        rows = stage(_filled(statistics_for(rows, labelled, spec=spec) if statistics else rows))
        found = stage(predict_routed(rows, models, routes, default, spec).withColumn("step", F.lit(step)))
        done.append(found)
        if step < weeks:
            flags = {spec.promo: F.lit(0), spec.period: F.lit(period), spec.value: F.coalesce("predicted_volume", F.lit(0.0))}
            if promos is not None:
                flags[spec.promo] = F.coalesce(F.col("__p"), F.lit(0))
                found = _planned(found, promos, spec)
            new = found.select(*[flags.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in labelled.columns])
            history = stage(_tail(history.select(*labelled.columns).unionByName(new), spec))
    if not done:
        rows = _filled(next_week_features(history, 1, 0, period, holidays, country, region, spec=spec))
        rows = statistics_for(rows, labelled, spec=spec) if statistics else rows
        return predict_routed(rows, models, routes, default, spec).withColumn("step", F.lit(1)).limit(0)
    return union_all(done)


def _planned(rows: DataFrame, promos: DataFrame, spec: SeriesSpec) -> DataFrame:
    plan = promos.groupBy(*spec.keys, spec.time).agg(F.max(spec.promo).cast("int").alias("__p"))
    return rows.join(plan, [*spec.keys, spec.time], "left")


def _next_promo(history: DataFrame, promos: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Adds the flag planned for the week after the end of the series to each of its rows."""
    plan = promos.groupBy(*spec.keys, spec.time).agg(F.max(spec.promo).cast("int").alias("__promo"))
    plan = plan.withColumnRenamed(spec.time, "__next")
    ends = history.withColumn("__next", F.date_add(F.max(spec.time).over(spec.by_series()), 7))
    joined = ends.join(plan, [*spec.keys, "__next"], "left").drop("__next")
    return joined.withColumn("__promo", F.coalesce("__promo", F.lit(0)))
