"""From table columns to the vector column of a model, as a pipeline that can be saved with the model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.operators.scale import median_values

HASH_DIMENSIONS = 1 << 12
VECTOR = "__features"


def category_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    return {c: int(row[c]) for c in columns}


def fit_encoder(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    mode: str = "onehot",
    missing: str = "missing",
    max_categories: int | None = None,
    approximate: bool = False,
    vector: str = VECTOR,
    medians: Mapping[str, float] | None = None,
) -> tuple[PipelineModel, int]:
    """Fitted preprocessing and the number of bins a tree needs for it.

    Missing numbers (null or NaN) become the median of the training rows, missing categories a value of their own. Categories
    are one-hot encoded (``mode="onehot"``, unseen ones are all zeros) or numbered (``mode="index"``, for trees).
    All columns are encoded alike whatever the number of their values. Only where ``max_categories`` is given are columns
    with more values than that hashed instead. ``mode="target"`` leaves the categorical columns out: their target statistics
    (``target_stats``) are numeric columns already, so nothing is learnt about categories here and the bins stay as they are.
    ``medians`` are taken as they are instead of being found in ``train``.
    """
    if mode not in ("onehot", "index", "target"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "target":
        categorical = []
    medians = median_values(train, numeric, approximate) if medians is None else dict(medians)
    numbers = [f"COALESCE(NANVL(CAST(`{c}` AS DOUBLE), NULL), {medians.get(c, 0.0)!r}D) AS `__n_{c}`" for c in numeric]
    texts = [f"COALESCE(CAST(`{c}` AS STRING), '{missing}') AS `__t_{c}`" for c in categorical]
    fill = SQLTransformer(statement=f"SELECT *, {', '.join([*numbers, *texts])} FROM __THIS__")
    df, stages = fill.transform(train), [fill]

    texts = [f"__t_{c}" for c in categorical]
    counts = {} if max_categories is None else category_counts(df, texts)
    many = [c for c, n in counts.items() if n > max_categories]
    known = [c for c in texts if c not in many]
    inputs, bins = [f"__n_{c}" for c in numeric], 32
    if known:
        numbered = [f"__i_{c}" for c in known]
        indexer = StringIndexer(inputCols=known, outputCols=numbered, handleInvalid="keep").fit(df)
        stages.append(indexer)
        if mode == "index":
            inputs += numbered
            bins = max(bins, max(len(labels) for labels in indexer.labelsArray) + 1)
        else:
            flags = [f"__o_{c}" for c in known]
            stages.append(OneHotEncoder(inputCols=numbered, outputCols=flags, dropLast=True).fit(indexer.transform(df)))
            inputs += flags
    if many:
        stages.append(FeatureHasher(inputCols=many, outputCol="__hashed", numFeatures=HASH_DIMENSIONS))
        inputs.append("__hashed")
    stages.append(VectorAssembler(inputCols=inputs, outputCol=vector, handleInvalid="error"))
    return PipelineModel(stages), bins
