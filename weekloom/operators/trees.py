"""Tree models per cluster: time-ordered search, holdout, metrics. Each fit runs on all executors."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.encode import VECTOR, fit_encoder
from weekloom.operators.lookup import LOOKUP_ROWS, bounded, lookup_join
from weekloom.operators.metrics import absolute_error, attach_mase, cluster_metrics, mase
from weekloom.operators.results import union_all
from weekloom.operators.sampling import sample_large_groups
from weekloom.operators.scale import fold_medians
from weekloom.operators.split import cv_folds, positional_split, week_share_split
from weekloom.operators.target_stats import ordered_target_statistics
from weekloom.session import in_parallel, stage
from weekloom.settings import (
    BOOSTED_SPACE,
    BOOSTED_TRIALS,
    CV_FOLDS,
    FOREST_SPACE,
    FOREST_TRIALS,
    SEED,
    TRAIN_RATIO,
)
from weekloom.spec import DEFAULT, SeriesSpec, feature_columns

FAMILIES = {
    "boosted": (GBTRegressor, BOOSTED_SPACE, BOOSTED_TRIALS),
    "forest": (RandomForestRegressor, FOREST_SPACE, FOREST_TRIALS),
}
NOT_FEATURES = ["last_sale_week", "split", "fold", "cutoff_week", "pos", "group_rows"]


def estimator(family: str, params: Mapping, label: str, bins: int, seed: int = SEED):
    kind = FAMILIES[family][0]
    return kind(featuresCol=VECTOR, labelCol=label, maxBins=bins, seed=seed, **params)


def draw_params(space: Mapping[str, Sequence], trials: int, seed: int = SEED) -> list[dict]:
    """Different random points of the grid."""
    points = list(itertools.product(*space.values()))
    chosen = random.Random(seed).sample(points, min(trials, len(points)))
    return [dict(zip(space, p, strict=True)) for p in chosen]


def model_columns(df: DataFrame, spec: SeriesSpec = DEFAULT) -> tuple[list[str], list[str]]:
    """Numeric and categorical inputs: all columns but target, date and label; the keys are categories."""
    names = feature_columns(df, [spec.value, spec.time, spec.label, *NOT_FEATURES])
    return [c for c in names if c not in spec.keys], [c for c in names if c in spec.keys]


def search(
    train: DataFrame,
    family: str,
    candidates: Sequence[Mapping],
    folds: int,
    threads: int = 2,
    mode: str = "index",
    spec: SeriesSpec = DEFAULT,
    medians: Mapping[int, Mapping[str, float]] | None = None,
    folds_at_once: int = 2,
) -> tuple[dict, float]:
    """Parameters with the least mean absolute error over the expanding folds (column ``fold``).

    A fold does not wait for the one before it; at most ``folds_at_once`` of them are encoded and kept at a time.
    ``medians`` are those of each fold's training rows, by fold, where they are known already.
    """
    numeric, categorical = model_columns(train, spec)

    def fold_errors(f: int) -> list[float]:
        past, ahead = train.filter(F.col("fold") < f), train.filter(F.col("fold") == f)
        known = None if medians is None else medians.get(f, {})
        encoder, bins = fit_encoder(past, numeric, categorical, mode, medians=known)
        keep = [spec.value, VECTOR]
        past_points = encoder.transform(past).select(*keep).persist()
        ahead_points = encoder.transform(ahead).select(*keep).persist()

        def score(params: Mapping) -> float:
            model = estimator(family, params, spec.value, bins).fit(past_points)
            miss = absolute_error(F.col(spec.value), F.col("prediction"))
            found = model.transform(ahead_points).agg(F.avg(miss)).first()[0]
            return math.inf if found is None else found

        try:
            return in_parallel(train.sparkSession, [lambda p=p: score(p) for p in candidates], threads)
        finally:
            past_points.unpersist()
            ahead_points.unpersist()

    by_fold = in_parallel(train.sparkSession, [lambda f=f: fold_errors(f) for f in range(folds)], folds_at_once)
    errors = list(zip(*by_fold, strict=True))
    means = [sum(e) / len(e) for e in errors]
    best = min(range(len(candidates)), key=means.__getitem__)
    return dict(candidates[best]), means[best]


def fit_model(
    train: DataFrame,
    family: str,
    params: Mapping,
    mode: str = "index",
    spec: SeriesSpec = DEFAULT,
    medians: Mapping[str, float] | None = None,
) -> PipelineModel:
    """Preprocessing and trees as one model."""
    numeric, categorical = model_columns(train, spec)
    encoder, bins = fit_encoder(train, numeric, categorical, mode, medians=medians)
    points = encoder.transform(train).select(spec.value, VECTOR)
    return PipelineModel([*encoder.stages, estimator(family, params, spec.value, bins).fit(points)])


def as_predictions(scored: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    return scored.select(
        *spec.keys,
        spec.time,
        F.col(spec.value).alias("actual_volume"),
        F.col("prediction").alias("predicted_volume"),
        spec.label,
    )


@dataclass
class Trained:
    """Models by label, their test predictions, and one metrics row per label (also for skipped and failed ones)."""

    models: dict[int, PipelineModel] = field(default_factory=dict)
    predictions: DataFrame | None = None
    metrics: DataFrame | None = None


def label_sizes(df: DataFrame, spec: SeriesSpec = DEFAULT) -> dict[int, tuple[int, int]]:
    """Rows and training rows (column ``split``) per label."""
    sizes = df.filter(F.col(spec.label).isNotNull()).groupBy(spec.label)
    sizes = bounded(sizes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train")))
    if sizes is None:
        raise ValueError(f"more than {LOOKUP_ROWS} clusters; a model per cluster is not meant for that")
    return {r[spec.label]: (r["n"], r["train"]) for r in sorted(sizes.collect())}


def cluster_medians(train: DataFrame, folds: int, spec: SeriesSpec = DEFAULT) -> dict[int, dict[int, dict[str, float]]]:
    """Medians by label, fold and column, of the columns with missing values; fold ``folds`` stands for all training rows.

    One count of missing values, and one aggregate and ordering for all clusters and folds. A column without a value before
    a fold has no median there and is filled with 0.
    """
    numeric, _ = model_columns(train, spec)
    missing = {c: F.col(c).cast("double") for c in numeric}
    facts = train.agg(*[F.count_if(v.isNull() | F.isnan(v)).alias(c) for c, v in missing.items()]).first()
    needed = [c for c in numeric if facts[c]]
    out: dict[int, dict[int, dict[str, float]]] = {}
    if needed:
        # at most clusters * folds * columns numbers
        for r in fold_medians(train, needed, folds, [spec.label]).collect():
            out.setdefault(r[spec.label], {}).setdefault(r["fold"], {})[r["feature"]] = r["median"]
    return out


def train_clusters(
    table: DataFrame,
    family: str = "boosted",
    space: Mapping[str, Sequence] | None = None,
    trials: int | None = None,
    folds: int = CV_FOLDS,
    ratio: float = TRAIN_RATIO,
    split: str = "chronological",
    sample: bool = False,
    threads: int = 2,
    clusters_at_once: int = 4,
    mode: str = "index",
    models_path: str | None = None,
    boundary: str = "per_series",
    spec: SeriesSpec = DEFAULT,
) -> Trained:
    """Search, fit and test one model per cluster.

    The table is split once for all clusters and stored by label, so that each cluster reads only its own files.
    A few clusters, and a few trials of each, are fitted at the same time to keep the executors busy. All rows are used unless
    ``sample`` asks for a sample of the large clusters.

    ``mode="target"`` replaces the keys by their target statistics in time order, found once for all clusters and folds, so
    any number of sites and items fits, while rows to predict need their statistics first; "index" and "onehot" number the
    keys of each training part, whose list the model then holds. The medians of all folds and clusters are found together.
    """
    _, default_space, default_trials = FAMILIES[family]
    candidates = draw_params(space or default_space, trials or default_trials)
    if sample:
        table = sample_large_groups(table, spec=spec)
    if mode == "target":
        table = ordered_target_statistics(table, spec=spec)
    splitter = {"chronological": week_share_split, "positional": positional_split}[split]
    parts = splitter(table, ratio, spec).drop("pos", "group_rows")
    train = cv_folds(parts.filter("split = 'train'"), folds, split, spec)
    test = parts.filter("split = 'test'").withColumn("fold", F.lit(None).cast("int"))
    stored = stage(train.unionByName(test), partition_by=[spec.label])
    counts = label_sizes(stored, spec)
    medians = cluster_medians(stored.filter("split = 'train'"), folds, spec)

    def train_one(label: int) -> tuple[tuple, PipelineModel | None, DataFrame | None]:
        n, n_train = counts[label]
        reason = _guard(n, n_train, folds)
        if reason:
            return (label, None, None, reason), None, None
        rows = stored.filter(F.col(spec.label) == label)
        try:
            train_rows = rows.filter("split = 'train'")
            known = medians.get(label, {})
            best, error = search(train_rows, family, candidates, folds, threads, mode, spec, known)
            model = fit_model(train_rows, family, best, mode, spec, known.get(folds, {}))
            if models_path:
                model.write().overwrite().save(f"{models_path}/cluster={label}")
        except Exception as failure:  # one bad cluster must not end the others
            return (label, None, None, f"failed: {failure}"), None, None
        return (label, str(best), error, "ok"), model, model.transform(rows.filter("split = 'test'"))

    work = [lambda label=label: train_one(label) for label in counts]
    done = in_parallel(stored.sparkSession, work, clusters_at_once)
    out = Trained(models={note[0]: model for note, model, _ in done if model is not None})
    scored = [as_predictions(rows, spec) for _, _, rows in done if rows is not None]
    _finish(out, scored, [note for note, _, _ in done], stored.filter("split = 'train'"), boundary, spec)
    return out


def _guard(rows: int, train_rows: int, folds: int) -> str | None:
    if rows < (folds + 2) * 2:
        return "skipped: too few rows"
    if train_rows < folds + 1:
        return "skipped: too few training rows"
    if rows - train_rows < 1:
        return "skipped: empty test"
    return None


def _finish(out: Trained, scored: list, notes: list, train: DataFrame, boundary: str, spec: SeriesSpec) -> None:
    spark = train.sparkSession
    status = spark.createDataFrame(notes, f"{spec.label} int, best_params string, cv_mae double, status string")
    if not scored:
        empty = as_predictions(train.withColumn("prediction", F.lit(None).cast("double")), spec).limit(0)
        scored = [empty]
    out.predictions = stage(union_all(scored))
    found = attach_mase(
        cluster_metrics(out.predictions, spec=spec), mase(train, out.predictions, boundary, spec=spec), spec
    )
    out.metrics = lookup_join(status, found, [spec.label]).select(
        spec.label, "mae", "rmse", "mape", "r2", "mase", "cv_mae", "best_params", "status"
    )


def load_models(spark: SparkSession, path: str, labels: Sequence[int]) -> dict[int, PipelineModel]:
    return {label: PipelineModel.load(f"{path}/cluster={label}") for label in labels}


def predict_clusters(rows: DataFrame, models: Mapping[int, PipelineModel], spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Each row predicted with the model of its cluster.

    Models trained with ``mode="target"`` need the target statistics of the rows: ``target_stats.statistics_for`` adds them.
    """
    return union_all(
        [as_predictions(m.transform(rows.filter(F.col(spec.label) == label)), spec) for label, m in models.items()]
    )
