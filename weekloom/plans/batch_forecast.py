"""Forecast and backtest all series, in runs that can be stopped and continued.

A run writes its own folders, and a manifest row when all of them are complete: the number and the set of its series, and
the rows of each table. Only runs with a manifest row count, so whatever a broken run left behind is neither read nor taken
as done, and two writers of one folder do not disturb each other: each has its own run, and a series that both forecast
counts with the later one. ``run_states`` compares the folders with the manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators import forecast as fc
from weekloom.operators.metrics import global_metrics, metric_summary, rank_results, series_metrics
from weekloom.operators.results import carried_over, remaining
from weekloom.operators.weekly import distinct_series, top_series
from weekloom.settings import ADDITIVE_DEFAULTS, FORECAST_WEEKS
from weekloom.spec import DEFAULT, SeriesSpec


@dataclass
class BatchResult:
    results: DataFrame
    forecasts: DataFrame
    backtests: DataFrame
    spec: SeriesSpec = DEFAULT

    @property
    def summary(self) -> DataFrame:
        return metric_summary(self.results.filter("status = 'ok'"))

    @property
    def ranking(self) -> DataFrame:
        return rank_results(self.results.filter("status = 'ok'"), self.spec)

    @property
    def totals(self) -> DataFrame:
        return global_metrics(self.backtests, self.spec)


# Spark's names for a missing folder and for one without data files.
NOTHING_WRITTEN = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _folder(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, None if nothing has been written; a damaged folder raises."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in NOTHING_WRITTEN:
            return None
        raise


TABLES = ("forecasts", "backtests", "results")


def _series_set(spec: SeriesSpec):
    """A sum over the series that tells sets of them apart, whatever their order."""
    return F.sum(F.xxhash64(*spec.keys).cast("decimal(38,0)")).cast("string")


def manifest(spark: SparkSession, output: str) -> DataFrame | None:
    """(run, series, series_set, forecasts, backtests, results, committed_at) of the finished runs, None without any."""
    return _folder(spark, f"{output}/manifest")


def run_states(spark: SparkSession, output: str, spec: SeriesSpec = DEFAULT) -> DataFrame | None:
    """Each run that has any folder, with its state; None where nothing has been written.

    ``complete``: the tables hold the rows and the series that its manifest row names; ``damaged``: they don't;
    ``unfinished``: there is no manifest row, the run broke off or is still being written.
    """
    counted = None
    for name in TABLES:
        table = _folder(spark, f"{output}/{name}")
        if table is None:
            continue
        facts = [F.count(F.lit(1)).alias(f"__{name}")]
        if name == "results":
            facts += [_series_set(spec).alias("__set")]
        own = table.groupBy("run").agg(*facts)
        counted = own if counted is None else counted.join(own, "run", "full")
    if counted is None:
        return None
    for name in [*TABLES, "set"]:
        if f"__{name}" not in counted.columns:
            counted = counted.withColumn(f"__{name}", F.lit(None).cast("string" if name == "set" else "long"))
    done = manifest(spark, output)
    if done is None:
        return counted.select("run", F.lit("unfinished").alias("state"))
    same = F.col("__set").eqNullSafe(F.col("series_set"))
    for name in TABLES:
        same = same & (F.coalesce(f"__{name}", F.lit(0)) == F.col(name))
    joined = counted.join(done, "run", "full")
    state = F.when(F.col("committed_at").isNull(), "unfinished").when(same, "complete").otherwise("damaged")
    return joined.select("run", state.alias("state"))


def read_results(spark: SparkSession, output: str, spec: SeriesSpec = DEFAULT) -> BatchResult | None:
    """All finished runs; a series that was forecast again counts with its latest run."""
    done, found = manifest(spark, output), _folder(spark, f"{output}/results")
    if done is None or found is None:
        return None
    found = found.join(done.select("run"), "run", "left_semi")
    latest = found.groupBy(*spec.keys).agg(F.max("run").alias("run"))
    results = found.join(latest, [*spec.keys, "run"], "left_semi")
    forecasts, backtests = (
        _folder(spark, f"{output}/{name}").join(latest, [*spec.keys, "run"], "left_semi").drop("run")
        for name in ("forecasts", "backtests")
    )
    return BatchResult(results.drop("run"), forecasts.filter("status = 'ok'"), backtests.filter("status = 'ok'"), spec)


def run_forecasts(
    weekly: DataFrame,
    output: str,
    top_n: int | None = None,
    resume: bool = True,
    weeks: int = FORECAST_WEEKS,
    params: Mapping = ADDITIVE_DEFAULTS,
    use_events: bool = True,
    spec: SeriesSpec = DEFAULT,
) -> BatchResult:
    """Forecast the series that have no result yet (all of them without ``resume``), largest only if ``top_n``."""
    spark = weekly.sparkSession
    wanted = top_series(weekly, top_n, spec) if top_n else distinct_series(weekly, spec)
    before = read_results(spark, output, spec) if resume else None
    if before is not None:
        wanted = remaining(wanted, before.results.filter("status <> 'failed'"), spec)
    rows = carried_over(weekly, wanted, spec)

    # The runs sort by their start, which decides between two results of one series.
    run = f"{spark.sql('SELECT unix_micros(now())').first()[0]:020d}-{uuid.uuid4().hex[:8]}"
    paths = {name: f"{output}/{name}/run={run}" for name in ("forecasts", "backtests", "results")}
    fc.forecast(rows, weeks, params, use_events, spec).write.mode("overwrite").parquet(paths["forecasts"])
    forecasts = spark.read.parquet(paths["forecasts"])
    fitted = carried_over(rows, forecasts.filter("status = 'ok'"), spec)
    fc.backtest(fitted, params, use_events, spec=spec).write.mode("overwrite").parquet(paths["backtests"])
    backtests = spark.read.parquet(paths["backtests"]).filter("status = 'ok'")
    scores = series_metrics(backtests, spec=spec).drop("data_points")
    table = fc.model_metadata(forecasts, spec).join(scores, spec.key_list, "left")
    table.withColumn("finished_at", F.current_timestamp()).write.mode("overwrite").parquet(paths["results"])
    _commit(spark, output, run, spec)
    return read_results(spark, output, spec)



def _commit(spark: SparkSession, output: str, run: str, spec: SeriesSpec) -> None:
    """The manifest row of a run, from what its tables hold now; it is the last thing that a run writes."""
    paths = {name: f"{output}/{name}/run={run}" for name in TABLES}
    stored = {name: spark.read.parquet(path) for name, path in paths.items()}
    rows = {name: table.count() for name, table in stored.items()}
    facts = stored["results"].agg(F.count(F.lit(1)).alias("series"), _series_set(spec).alias("series_set"))
    row = facts.withColumns({name: F.lit(n).cast("long") for name, n in rows.items()})
    row = row.withColumn("committed_at", F.current_timestamp())
    row.coalesce(1).write.mode("errorifexists").parquet(f"{output}/manifest/run={run}")
