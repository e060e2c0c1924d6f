"""Forecasts of all series: Spark shuffles the table by series once and fits each series in a pandas group.

A group is one series, so its size is bounded by the number of weeks, whatever the size of the table. Cutoffs and
parameter combinations are looped over inside the group, so no row is copied for them. A series that fails gives
a row with the reason; the others are not affected.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.functions import additive
from weekloom.operators.clean import as_model_input
from weekloom.session import workers_find_package
from weekloom.settings import (
    ADDITIVE_DEFAULTS,
    ADDITIVE_GRID,
    BACKTEST_WEEKS,
    FORECAST_WEEKS,
    MIN_POINTS_FIT,
    MIN_POINTS_TUNING,
    TRAIN_RATIO,
)
from weekloom.spec import DEFAULT, SeriesSpec

STATUS = "status string, error string, data_points int"


def _by_series(
    df: DataFrame, body: Callable[[pd.DataFrame], pd.DataFrame], schema: str, least: int, spec: SeriesSpec
) -> DataFrame:
    """Run ``body`` per series on (ds, y, flags) in time order, with skipped and failed series as status rows."""
    keys = spec.key_list
    types = dict(df.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        ids, points = {k: pdf[k].iloc[0] for k in keys}, len(pdf)
        if points < least:
            out = pd.DataFrame({"status": ["skipped"], "error": ["insufficient data points"]})
        else:
            try:
                out = body(pdf).assign(status="ok", error=None)
                if out.empty:
                    out = pd.DataFrame({"status": ["skipped"], "error": ["no cutoff fits into the series"]})
            except Exception as failure:  # one bad series must not end the job
                out = pd.DataFrame({"status": ["failed"], "error": [str(failure)]})
        out = out.assign(**ids, data_points=points)
        return out.assign(**{c: None for c in names if c not in out.columns})[names]

    # Series are light in bytes but heavy in work: a fixed number of partitions is not merged by its bytes.
    spark = df.sparkSession
    workers_find_package(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    full = f"{head}, {schema}, {STATUS}"
    names = [*keys, *[part.split()[0].strip("`") for part in schema.split(",")], "status", "error", "data_points"]
    return as_model_input(df, spec).repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, full)


class _Rows(NamedTuple):
    """One series as arrays in time order; days are counted from 1970-01-01."""

    days: np.ndarray
    y: np.ndarray
    events: np.ndarray

    def between(self, start: float, end: float) -> _Rows:
        """Rows with ``start < day <= end``."""
        cut = slice(*np.searchsorted(self.days, [start, end], side="right"))
        return _Rows(self.days[cut], self.y[cut], self.events[cut])


def _rows(pdf: pd.DataFrame, flags: list[str]) -> _Rows:
    events = pdf[flags].fillna(0).to_numpy(float) if flags else np.zeros((len(pdf), 0))
    days = pd.to_datetime(pdf["ds"]).to_numpy().astype("datetime64[D]").astype(float)
    return _Rows(days, pdf["y"].to_numpy(float), events)


def _dates(days: np.ndarray) -> np.ndarray:
    return days.astype(int).astype("datetime64[D]").astype(object)


def _fit_many(histories: Sequence[_Rows], params: Sequence[Mapping]) -> list[additive.Additive]:
    """All given parameters must have the same mode. Weeks without a value are left out."""
    known = [_Rows(*(a[np.isfinite(rows.y)] for a in rows)) for rows in histories]
    if any(len(rows.y) < 2 for rows in known):
        raise ValueError("fewer than two values")
    bends = np.array([float(p["changepoint_prior_scale"]) for p in params])
    seasons = np.array([float(p["seasonality_prior_scale"]) for p in params])
    return additive.fit_many(known, bends, seasons, params[0]["seasonality_mode"] == "multiplicative")


def _fit(rows: _Rows, params: Sequence[Mapping]) -> additive.Additive:
    return _fit_many([rows], params)[0]


def _flags(df: DataFrame, spec: SeriesSpec, use_events: bool) -> list[str]:
    return [c for c in (spec.promo, spec.period) if use_events and c in df.columns]


def forecast(
    df: DataFrame,
    weeks: int = FORECAST_WEEKS,
    params: Mapping = ADDITIVE_DEFAULTS,
    use_events: bool = True,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Fitted history and the weeks after it, without promotions and flagged period, with the model's parameters.

    ``converged`` says whether the fit settled within its rounds.
    """
    flags = _flags(df, spec, use_events)

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(pdf, flags)
        model = _fit(rows, [params])
        days = np.concatenate([rows.days, rows.days[-1] + 7 * np.arange(1, weeks + 1)])
        found = model.predict(days, np.zeros((len(days), len(flags))))
        return pd.DataFrame({"ds": _dates(days), **{c: v[0] for c, v in found.items()}}).assign(
            is_future=days > rows.days[-1],
            k=model.trend[0, 1],
            m=model.trend[0, 0],
            sigma_obs=model.sigma[0],
            converged=model.converged[0],
            start_date=pdf["ds"].iloc[0],
            end_date=pdf["ds"].iloc[-1],
        )

    schema = (
        "ds date, yhat double, yhat_lower double, yhat_upper double, trend double, yearly double, "
        "is_future boolean, k double, m double, sigma_obs double, converged boolean, start_date date, end_date date"
    )
    return _by_series(df, body, schema, MIN_POINTS_FIT, spec)


def model_metadata(forecasts: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """One row per series: status and, where there is a model, its parameters as a struct."""
    params = F.struct("k", "m", "sigma_obs")
    return forecasts.groupBy(*spec.keys).agg(
        F.concat_ws("_", *[F.first(k) for k in spec.keys]).alias("series_id"),
        F.first("status").alias("status"),
        F.first("error").alias("error"),
        F.first("data_points").alias("data_points"),
        F.date_format(F.first("start_date"), "yyyy-MM-dd").alias("start_date"),
        F.date_format(F.first("end_date"), "yyyy-MM-dd").alias("end_date"),
        F.first(params).alias("params"),
    )


def _folds(rows: _Rows, initial: int, period: int, horizon: int):
    """(cutoff, rows up to it, rows of its horizon, weeks from the cutoff), latest cutoff first."""
    cutoff = rows.days[-1] - 7 * horizon
    while cutoff >= rows.days[0] + 7 * initial:
        test = rows.between(cutoff, cutoff + 7 * horizon)
        if len(test.y):
            yield cutoff, rows.between(-np.inf, cutoff), test, ((test.days - cutoff) // 7).astype(int)
        cutoff -= 7 * period


def backtest(
    df: DataFrame,
    params: Mapping = ADDITIVE_DEFAULTS,
    use_events: bool = True,
    initial: int = BACKTEST_WEEKS["initial"],
    period: int = BACKTEST_WEEKS["period"],
    horizon: int = BACKTEST_WEEKS["horizon"],
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Rolling-origin forecasts: at each cutoff the model sees only the weeks up to it; ``converged`` as in ``forecast``."""
    flags = _flags(df, spec, use_events)

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        folds = list(_folds(_rows(pdf, flags), initial, period, horizon))
        if not folds:
            return pd.DataFrame(columns=["ds"])
        models = _fit_many([train for _, train, _, _ in folds], [params])
        found = [model.predict(test.days, test.events) for model, (_, _, test, _) in zip(models, folds, strict=True)]
        sizes = [len(test.y) for _, _, test, _ in folds]
        out = {
            "ds": _dates(np.concatenate([test.days for _, _, test, _ in folds])),
            "cutoff": _dates(np.repeat([cutoff for cutoff, _, _, _ in folds], sizes)),
            "horizon_weeks": np.concatenate([ahead for _, _, _, ahead in folds]),
            "y": np.concatenate([test.y for _, _, test, _ in folds]),
        }
        out |= {c: np.concatenate([f[c][0] for f in found]) for c in ("yhat", "yhat_lower", "yhat_upper")}
        out["converged"] = np.repeat([bool(model.converged[0]) for model in models], sizes)
        return pd.DataFrame(out)

    schema = (
        "ds date, cutoff date, horizon_weeks int, y double, yhat double, yhat_lower double, yhat_upper double, "
        "converged boolean"
    )
    return _by_series(df, body, schema, MIN_POINTS_FIT, spec)


def _grid(grid: Mapping) -> dict[str, list[dict]]:
    """All combinations, put together by mode."""
    names = list(grid)
    combos = [dict(zip(names, values, strict=True)) for values in itertools.product(*grid.values())]
    return {m: [c for c in combos if c["seasonality_mode"] == m] for m in grid["seasonality_mode"]}


def _grid_errors(rows: _Rows, modes: Mapping, initial: int, period: int, horizon: int) -> pd.DataFrame:
    """Squared errors per parameter combination and distance from the cutoff."""
    combos = [c for group in modes.values() for c in group]
    squared, counts = np.zeros((len(combos), horizon + 1)), np.zeros(horizon + 1, dtype=int)
    folds = list(_folds(rows, initial, period, horizon))
    models = [_fit_many([train for _, train, _, _ in folds], group) for group in modes.values()]
    for i, (_, _, test, ahead) in enumerate(folds):
        yhat = [of_mode[i].predict(test.days, test.events)["yhat"] for of_mode in models]
        np.add.at(squared, (slice(None), ahead), (np.vstack(yhat) - test.y) ** 2)
        np.add.at(counts, ahead, 1)
    seen = np.flatnonzero(counts)
    out = pd.DataFrame(combos).loc[np.repeat(np.arange(len(combos)), len(seen))]
    return out.assign(
        horizon_weeks=np.tile(seen, len(combos)),
        squared_error=squared[:, seen].ravel(),
        n=np.tile(counts[seen], len(combos)),
    )


GRID_SCHEMA = "seasonality_mode string, changepoint_prior_scale double, seasonality_prior_scale double"


def grid_search(
    df: DataFrame,
    grid: Mapping = ADDITIVE_GRID,
    use_events: bool = True,
    initial: int = BACKTEST_WEEKS["initial"],
    period: int = BACKTEST_WEEKS["period"],
    horizon: int = BACKTEST_WEEKS["horizon"],
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Backtest error of every parameter combination: the mean over the horizons of their RMSE.

    A series that was skipped or failed has one row with its status, without parameters and error.
    """
    flags, modes = _flags(df, spec, use_events), _grid(grid)

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        return _grid_errors(_rows(pdf, flags), modes, initial, period, horizon)

    schema = f"{GRID_SCHEMA}, horizon_weeks int, squared_error double, n int"
    errors = _by_series(df, body, schema, MIN_POINTS_FIT, spec)
    rmse = F.avg(F.sqrt(F.col("squared_error") / F.col("n"))).alias("rmse")
    return errors.groupBy(*spec.keys, *ADDITIVE_GRID, "status").agg(rmse)


def tuned_against_default(
    df: DataFrame,
    grid: Mapping = ADDITIVE_GRID,
    params: Mapping = ADDITIVE_DEFAULTS,
    ratio: float = TRAIN_RATIO,
    use_events: bool = True,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Forecasts of the last part of each series by the default model and by one tuned on the first part."""
    flags, modes = _flags(df, spec, use_events), _grid(grid)
    names = list(grid)

    def body(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(pdf, flags)
        border = int(len(pdf) * ratio)
        train, test = (_Rows(*(a[part] for a in rows)) for part in (slice(border), slice(border, None)))
        errors = _grid_errors(train, modes, **BACKTEST_WEEKS)
        if errors.empty:
            raise ValueError("training part too short for a backtest")
        errors["rmse"] = np.sqrt(errors["squared_error"] / errors["n"])
        best = dict(zip(names, errors.groupby(names)["rmse"].mean().idxmin(), strict=True))
        default, tuned = (_fit(train, [p]).predict(test.days, test.events)["yhat"][0] for p in (params, best))
        return pd.DataFrame(
            {"ds": _dates(test.days), "y": test.y, "default_yhat": default, "tuned_yhat": tuned}
        ).assign(**best)

    schema = f"ds date, y double, default_yhat double, tuned_yhat double, {GRID_SCHEMA}"
    return _by_series(df, body, schema, MIN_POINTS_TUNING, spec)


def naive_backtest(
    df: DataFrame,
    initial: int = BACKTEST_WEEKS["initial"],
    period: int = BACKTEST_WEEKS["period"],
    horizon: int = BACKTEST_WEEKS["horizon"],
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Reference forecasts by windows only: the value 52 weeks before, else the level at the cutoff.

    The level is the mean of the twelve weeks up to the cutoff, its deviation gives the interval. Needs one
    cutoff per row, that is a period of at least the horizon.
    """
    from weekloom.operators.split import backtest_rows

    if period < horizon or horizon > 52:
        raise ValueError("needs horizon <= period and horizon <= 52 weeks")
    w = spec.in_time()
    recent = w.rowsBetween(-11, 0)
    lagged = df.withColumns(
        {
            "__season": F.lag(spec.value, 52).over(w),
            "__state": F.struct(
                F.avg(spec.value).over(recent).alias("level"), F.stddev_samp(spec.value).over(recent).alias("spread")
            ),
        }
    )
    # The rows of a horizon directly follow their cutoff: its state lies as many rows back as the distance.
    states = F.collect_list("__state").over(w.rowsBetween(-horizon, -1))
    rows = backtest_rows(lagged.withColumn("__states", states), initial, period, horizon, spec)
    state = F.element_at("__states", -F.col("horizon_weeks"))
    yhat = F.coalesce(F.col("__season"), state["level"])
    margin = F.lit(1.96) * F.coalesce(state["spread"], F.lit(0.0))
    return rows.select(
        *spec.keys,
        F.col(spec.time).alias("ds"),
        "cutoff",
        "horizon_weeks",
        F.col(spec.value).alias("y"),
        yhat.alias("yhat"),
        (yhat - margin).alias("yhat_lower"),
        (yhat + margin).alias("yhat_upper"),
    )
