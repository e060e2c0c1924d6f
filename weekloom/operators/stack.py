"""Two-level models: out-of-fold predictions of boosted trees feed a ridge or boosted meta-model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.functions.numeric import clamp
from weekloom.operators.clean import drop_incomplete, fill_category, is_complete
from weekloom.operators.encode import VECTOR, fit_encoder
from weekloom.operators.metrics import cluster_metrics
from weekloom.operators.results import fill_out_of_fold, remaining_labels, union_all
from weekloom.operators.split import adaptive_folds, chronological_split, cv_folds
from weekloom.operators.trees import NOT_FEATURES, label_sizes
from weekloom.operators.weekly import recent_rows
from weekloom.session import in_parallel, stage
from weekloom.settings import (
    CATEGORICAL_FEATURES,
    CV_FOLDS,
    CV_FOLDS_CLUSTER,
    RIDGE_ALPHA,
    SEED,
    STACK_BASE_CLUSTER,
    STACK_BASE_GLOBAL,
    STACK_META_BOOSTED,
    STACK_PATIENCE,
    TEST_WEEKS,
)
from weekloom.spec import DEFAULT, SeriesSpec, feature_columns

OOF = "oof_pred"
FITS_AT_ONCE = 2
GROWTH = 4  # of a model whose best prefix is not known yet; small steps fit the same first trees again and again


def prepare(
    table: DataFrame,
    test_weeks: int = TEST_WEEKS,
    group: list[str] | None = None,
    max_rows: int | None = None,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Rows with a full past, categories as text, and the split into training and the last weeks."""
    if max_rows is not None:
        table = recent_rows(table, max_rows, spec, group)
    complete = drop_incomplete(table)
    categories = [c for c in CATEGORICAL_FEATURES if c in complete.columns]
    return chronological_split(fill_category(complete, categories), test_weeks, spec, group)


def series_status(table: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Every series of a feature table with its weeks, those that ``prepare`` can use, and a status.

    A series without a usable week is in neither the training nor the test rows of a stack; here it has the status
    ``short history``, so that a report can name it. One aggregate, partial before the shuffle.
    """
    used = F.count_if(is_complete(table)).alias("usable_weeks")
    counts = table.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("weeks"), used)
    return counts.withColumn("status", F.when(F.col("usable_weeks") > 0, "ok").otherwise("short history"))


def _inputs(df: DataFrame, spec: SeriesSpec) -> tuple[list[str], list[str]]:
    names = feature_columns(df, [spec.value, spec.time, spec.label, OOF, *NOT_FEATURES])
    categorical = [c for c in names if c in CATEGORICAL_FEATURES]
    return [c for c in names if c not in categorical], categorical


def best_prefix(losses: Sequence[float], patience: int) -> int:
    """Number of trees of least loss before the first run of ``patience`` trees without a lower one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def _tree_count(points: DataFrame, params: Mapping, patience: int) -> int:
    """Trees that predict the held rows best, fitted without them.

    Spark's own validation ends at the first tree that does not help. Here a model is fitted in full, the loss of all its
    prefixes is read at once, and a model ``GROWTH`` times as long follows while the best prefix lies less than ``patience``
    trees before its end. The same seed gives the same first trees, so a longer model only adds to the prefixes.
    """
    past, held = points.filter("NOT __held"), points.filter("__held")
    limit = params["maxIter"]
    rounds = min(limit, 2 * patience)
    while True:
        model = GBTRegressor(**{**params, "maxIter": rounds}).fit(past)
        kept = best_prefix(model.evaluateEachIteration(held, "absolute"), patience)
        if kept + patience <= rounds or rounds == limit:
            return kept
        rounds = min(GROWTH * rounds, limit)


def latest_weeks(train: DataFrame, weeks: int = TEST_WEEKS, spec: SeriesSpec = DEFAULT) -> Column | None:
    """Condition for the last weeks of a table, at most a fifth of its time; None if it spans less than five weeks."""
    ends = train.agg(F.min(spec.time).alias("first"), F.max(spec.time).alias("last")).first()
    if ends["last"] is None:
        return None
    span = (ends["last"] - ends["first"]).days // 7 + 1
    if span < 5:
        return None
    return F.col(spec.time) > F.lit(ends["last"]) - F.expr(f"INTERVAL {7 * min(weeks, span // 5)} DAYS")


def fit_base(
    train: DataFrame,
    params: Mapping,
    held: Column | None = None,
    patience: int = STACK_PATIENCE,
    spec: SeriesSpec = DEFAULT,
) -> PipelineModel:
    """Boosted trees on the numbered categories.

    With ``held``, a condition for the latest of the training rows, the number of trees is found on those rows, and the
    model is then fitted again with that many trees on all rows. The test rows play no part in it.
    """
    numeric, categorical = _inputs(train, spec)
    encoder, bins = fit_encoder(train, numeric, categorical, "index")
    params = {**params, "featuresCol": VECTOR, "labelCol": spec.value, "maxBins": bins, "seed": SEED}
    marked = train.withColumn("__held", F.lit(False) if held is None else F.coalesce(held, F.lit(False)))
    points = encoder.transform(marked).select(spec.value, VECTOR, "__held").persist()
    try:
        if held is not None:
            params["maxIter"] = _tree_count(points, params, patience)
        model = GBTRegressor(**params).fit(points)
    finally:
        points.unpersist()
    return PipelineModel([*encoder.stages, model])


def _predict(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).select(*rows.columns, F.col("prediction").alias(name))


def out_of_fold(
    train: DataFrame,
    folds: int,
    params: Mapping,
    fill: str = "mean",
    patience: int = STACK_PATIENCE,
    spec: SeriesSpec = DEFAULT,
    threads: int = FITS_AT_ONCE,
) -> DataFrame:
    """Each row of a validation fold predicted by a model of earlier rows; the first rows get the mean or go.

    The fold before the predicted one stops the trees; before the first fold the last weeks of its training rows do.
    A fold is predicted as soon as its model is there, so that the driver holds no model longer than it is fitted.
    """

    def predict_fold(f: int) -> DataFrame:
        past = train.filter(F.col("fold") < f)
        held = F.col("fold") == f - 1 if f else latest_weeks(past, spec=spec)
        return stage(_predict(fit_base(past, params, held, patience, spec), train.filter(F.col("fold") == f), OOF))

    parts = [train.filter("fold < 0").withColumn(OOF, F.lit(None).cast("double"))]
    parts += in_parallel(train.sparkSession, [lambda f=f: predict_fold(f) for f in range(folds)], threads)
    return fill_out_of_fold(stage(union_all(parts)), OOF, fill, [], spec)


def ridge(train: DataFrame, alpha: float, vector: str, label: str) -> LinearRegression:
    """Ridge regression with penalty ``alpha`` on the sum of squares, in the terms of Spark's estimator."""
    row = train.agg(F.stddev_pop(label).alias("s"), F.count(F.lit(1)).alias("n")).first()
    penalty = alpha * (row["s"] or 1.0) / max(row["n"], 1)
    return LinearRegression(
        featuresCol=vector, labelCol=label, elasticNetParam=0.0, regParam=penalty, standardization=False
    )


def fit_meta(
    train: DataFrame,
    kind: str = "ridge",
    alpha: float = RIDGE_ALPHA,
    params: Mapping = STACK_META_BOOSTED,
    spec: SeriesSpec = DEFAULT,
) -> PipelineModel:
    """Meta-model on the original features and the out-of-fold prediction."""
    numeric, categorical = _inputs(train, spec)
    mode = "onehot" if kind == "ridge" else "index"
    encoder, bins = fit_encoder(train, [*numeric, OOF], categorical, mode)
    points = encoder.transform(train).select(spec.value, VECTOR).persist()
    try:
        if kind == "ridge":
            model = ridge(points, alpha, VECTOR, spec.value).fit(points)
        elif kind == "boosted":
            model = GBTRegressor(featuresCol=VECTOR, labelCol=spec.value, maxBins=bins, seed=SEED, **params).fit(points)
        else:
            raise ValueError(f"unknown meta-model {kind}")
    finally:
        points.unpersist()
    return PipelineModel([*encoder.stages, model])


@dataclass
class Stack:
    base: PipelineModel
    meta: PipelineModel

    def predict(self, rows: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
        """Stacked predictions, never below 0."""
        scored = self.meta.transform(_predict(self.base, rows, OOF))
        return scored.select(
            *spec.keys,
            spec.time,
            F.col(spec.value).alias("actual_volume"),
            clamp(F.col("prediction")).alias("stacking_predicted_volume"),
            spec.label,
        )

    def save(self, path: str) -> None:
        self.base.write().overwrite().save(f"{path}/base")
        self.meta.write().overwrite().save(f"{path}/meta")

    @staticmethod
    def load(path: str) -> Stack:
        return Stack(PipelineModel.load(f"{path}/base"), PipelineModel.load(f"{path}/meta"))


def fit_stack(
    train: DataFrame,
    folds: int,
    params: Mapping,
    meta: str = "ridge",
    meta_params: Mapping = STACK_META_BOOSTED,
    fill: str = "mean",
    group: list[str] | None = None,
    spec: SeriesSpec = DEFAULT,
) -> Stack:
    """The base model of all rows does not wait for those of the folds."""
    folded = stage(cv_folds(train, folds, "chronological", spec, group or []))

    def fit_level_two() -> PipelineModel:
        return fit_meta(out_of_fold(folded, folds, params, fill, spec=spec), meta, params=meta_params, spec=spec)

    def fit_all() -> PipelineModel:
        return fit_base(folded, params, F.col("fold") == folds - 1, spec=spec)

    meta_model, base = in_parallel(train.sparkSession, [fit_level_two, fit_all], 2)
    return Stack(base, meta_model)


def _scores(predictions: DataFrame, spec: SeriesSpec, group: list[str]) -> DataFrame:
    return cluster_metrics(predictions, predicted="stacking_predicted_volume", spec=spec, group=group)


def stack_global(
    table: DataFrame,
    folds: int = CV_FOLDS,
    params: Mapping = STACK_BASE_GLOBAL,
    meta: str = "ridge",
    meta_params: Mapping = STACK_META_BOOSTED,
    fill: str = "mean",
    test_weeks: int = TEST_WEEKS,
    path: str | None = None,
    spec: SeriesSpec = DEFAULT,
) -> tuple[DataFrame, DataFrame]:
    """One stack for all series: test predictions, and their metrics as one row."""
    rows = stage(prepare(table, test_weeks, [], spec=spec))
    model = fit_stack(rows.filter("split = 'train'"), folds, params, meta, meta_params, fill, spec=spec)
    if path:
        model.save(path)
    predictions = stage(model.predict(rows.filter("split = 'test'"), spec))
    return predictions, _scores(predictions, spec, [])


def stack_clusters(
    table: DataFrame,
    folds: int = CV_FOLDS_CLUSTER,
    params: Mapping = STACK_BASE_CLUSTER,
    meta: str = "ridge",
    meta_params: Mapping = STACK_META_BOOSTED,
    fill: str = "mean",
    test_weeks: int = TEST_WEEKS,
    max_rows: int | None = None,
    done: DataFrame | None = None,
    path: str | None = None,
    clusters_at_once: int = 2,
    spec: SeriesSpec = DEFAULT,
) -> tuple[DataFrame | None, DataFrame]:
    """One stack per cluster: test predictions, and a row of metrics and status per cluster.

    Clusters in ``done`` are left out, so that a stopped run can go on. Three base models of a cluster are fitted at a time,
    and the driver holds those of ``clusters_at_once`` clusters.
    """
    if done is not None:
        table = remaining_labels(table, done, spec)
    rows = stage(prepare(table, test_weeks, [spec.label], max_rows, spec), partition_by=[spec.label])
    counts = label_sizes(rows, spec)

    def stack_one(label: int) -> tuple[tuple, DataFrame | None]:
        n, n_train = counts[label]
        if n < 2 * test_weeks:
            return (label, "skipped: too few rows"), None
        if n_train < folds + 1:
            return (label, "skipped: too few training rows"), None
        if n == n_train:
            return (label, "skipped: empty test"), None
        part = rows.filter(F.col(spec.label) == label)
        train, test = part.filter("split = 'train'"), part.filter("split = 'test'")
        try:
            model = fit_stack(train, adaptive_folds(n_train, folds), params, meta, meta_params, fill, spec=spec)
            if path:
                model.save(f"{path}/cluster={label}")
        except Exception as failure:  # one bad cluster must not end the others
            return (label, f"failed: {failure}"), None
        return (label, "ok"), stage(model.predict(test, spec))  # the model goes, whatever the number of clusters

    work = [lambda label=label: stack_one(label) for label in counts]
    found = in_parallel(rows.sparkSession, work, clusters_at_once)
    notes, parts = [note for note, _ in found], [p for _, p in found if p is not None]
    status = table.sparkSession.createDataFrame(notes, f"{spec.label} int, status string")
    if not parts:
        return None, status
    predictions = union_all(parts)
    scores = _scores(predictions, spec, [spec.label]).select(spec.label, "row_count", "mae", "rmse", "r2")
    return predictions, status.join(F.broadcast(scores), [spec.label], "left")
