"""Time-ordered holdouts, folds and backtest cutoffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.lookup import prefix_totals, spread_join
from weekloom.settings import BACKTEST_WEEKS, CV_FOLDS, TEST_WEEKS, TRAIN_RATIO
from weekloom.spec import DEFAULT, SeriesSpec


def _group(spec: SeriesSpec, group: list[str] | None) -> list[str]:
    return [spec.label] if group is None else list(group)


def positions(df: DataFrame, spec: SeriesSpec = DEFAULT, group: list[str] | None = None) -> DataFrame:
    """Position of each row in its group, sorted by (series, time), from 0, and the size of the group.

    Only series are ordered across the group: inside buckets of the first key, its first characters before the whole. Rows
    are numbered inside their series. Building the plan starts no job.
    """
    group = _group(spec, group)
    counts = df.groupBy(*group, *spec.keys).agg(F.count(F.lit(1)).alias("__n"))
    first = spec.key_list[0]
    text = dict(df.dtypes)[first] == "string"
    levels = [*([F.substring(first, 1, 2)] if text else []), F.col(first)]
    starts = prefix_totals(counts, group, spec.key_list, {"__p": F.col("__n")}, levels).drop("__n")
    starts = starts.withColumnsRenamed({"__p_before": "__start", "__p_total": "group_rows"})
    numbered = df.join(starts, [*group, *spec.keys])
    within = F.row_number().over(Window.partitionBy(*group, *spec.keys).orderBy(spec.time))
    return numbered.withColumn("pos", F.col("__start") + within - 1).select(*df.columns, "pos", "group_rows")


def _train_test(is_train):
    return F.when(is_train, F.lit("train")).otherwise(F.lit("test"))


def positional_split(
    df: DataFrame, ratio: float = TRAIN_RATIO, spec: SeriesSpec = DEFAULT, group: list[str] | None = None
) -> DataFrame:
    """The first share of the rows, sorted by series and time, is for training: whole series end up in the test."""
    border = F.floor(F.col("group_rows") * F.lit(ratio))
    return positions(df, spec, group).withColumn("split", _train_test(F.col("pos") < border))


def chronological_split(
    df: DataFrame, weeks: int = TEST_WEEKS, spec: SeriesSpec = DEFAULT, group: list[str] | None = None
) -> DataFrame:
    """The last weeks of the group are the test; without any earlier row the first week stays for training."""
    group = _group(spec, group)
    if not group:
        whole = chronological_split(df.withColumn("__all", F.lit(1)), weeks, spec, ["__all"])
        return whole.drop("__all")
    bounds = df.groupBy(*group).agg(F.min(spec.time).alias("__first"), F.max(spec.time).alias("__last"))
    cutoffs = bounds.select(
        *group, F.greatest(F.date_sub("__last", 7 * weeks), F.col("__first")).alias("cutoff_week")
    )
    joined = spread_join(df, cutoffs, group, "inner")
    return joined.withColumn("split", _train_test(F.col(spec.time) <= F.col("cutoff_week")))


def week_share_split(
    df: DataFrame, ratio: float = TRAIN_RATIO, spec: SeriesSpec = DEFAULT, group: list[str] | None = None
) -> DataFrame:
    """The first share of the weeks of the group is for training, the later weeks are the test."""
    group = _group(spec, group)
    placed = _week_places(df, spec, group)
    side = placed.select(*group, spec.time, _train_test(F.col("__place") < F.floor(F.col("__size") * F.lit(ratio))).alias("split"))
    return spread_join(df, side, [*group, spec.time], "inner").select(*df.columns, "split")


def _week_places(df: DataFrame, spec: SeriesSpec, group: list[str]) -> DataFrame:
    """The weeks of each group, numbered from 0, and how many there are: a table of weeks, not of rows."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    weeks = df.select(*group, spec.time).distinct()
    return weeks.withColumn("__place", F.row_number().over(whole.orderBy(spec.time)) - 1).withColumn(
        "__size", F.count(F.lit(1)).over(whole)
    )


def per_series_split(df: DataFrame, ratio: float = TRAIN_RATIO, spec: SeriesSpec = DEFAULT) -> DataFrame:
    rank = F.row_number().over(spec.in_time())
    rows = F.count(F.lit(1)).over(spec.by_series())
    return (
        df.withColumn("__rank", rank)
        .withColumn("__rows", rows)
        .withColumn("split", _train_test(F.col("__rank") <= F.floor(F.col("__rows") * F.lit(ratio))))
        .drop("__rank", "__rows")
    )


def adaptive_folds(rows: int, most: int) -> int:
    """Fewer folds for small groups, but never less than two."""
    return min(most, max(2, rows // 100))


def fold_count(rows: Column, most: int) -> Column:
    """``adaptive_folds`` for a column of group sizes."""
    return F.least(F.lit(most), F.greatest(F.lit(2), F.floor(rows / 100))).cast("int")


def _fold(place, size, folds: int):
    """Fold whose validation part holds the place; -1 for places that are only ever trained on."""
    length = F.greatest(F.lit(1), F.floor(size / F.lit(folds + 1)))
    first = size - F.lit(folds) * length
    return F.when(place < first, F.lit(-1)).otherwise(F.floor((place - first) / length)).cast("int")


def cv_folds(
    df: DataFrame,
    folds: int = CV_FOLDS,
    mode: str = "chronological",
    spec: SeriesSpec = DEFAULT,
    group: list[str] | None = None,
) -> DataFrame:
    """Expanding-window folds: fold f validates on rows with ``fold = f`` and trains on rows with ``fold < f``.

    ``mode="positional"`` cuts the rows sorted by (series, time) into equal parts. ``mode="chronological"`` cuts
    the weeks of the group into equal parts, so that no fold is trained on weeks after its validation weeks.
    """
    group = _group(spec, group)
    if mode == "positional":
        placed = positions(df, spec, group)
        return placed.withColumn("fold", _fold(F.col("pos"), F.col("group_rows"), folds)).drop("pos", "group_rows")
    if mode != "chronological":
        raise ValueError(f"unknown mode {mode}")
    placed = _week_places(df, spec, group)
    fold_of_week = placed.select(*group, spec.time, _fold(F.col("__place"), F.col("__size"), folds).alias("fold"))
    return spread_join(df, fold_of_week, [*group, spec.time], "inner").select(*df.columns, "fold")


def backtest_cutoffs(
    df: DataFrame,
    initial: int = BACKTEST_WEEKS["initial"],
    period: int = BACKTEST_WEEKS["period"],
    horizon: int = BACKTEST_WEEKS["horizon"],
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """One row per series and cutoff, from the end of the series backwards; short series have none."""
    bounds = df.groupBy(*spec.keys).agg(F.min(spec.time).alias("__first"), F.max(spec.time).alias("__last"))
    last = F.date_sub("__last", 7 * horizon)
    first = F.date_add("__first", 7 * initial)
    return bounds.filter(last >= first).select(
        *spec.keys, F.explode(F.sequence(last, first, F.expr(f"interval -{7 * period} days"))).alias("cutoff")
    )


def backtest_rows(
    df: DataFrame,
    initial: int = BACKTEST_WEEKS["initial"],
    period: int = BACKTEST_WEEKS["period"],
    horizon: int = BACKTEST_WEEKS["horizon"],
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Each row once per cutoff whose horizon it lies in, with the distance in weeks.

    The cutoffs of a row follow from the ends of its series, so training rows are never copied per cutoff.
    """
    first, last = F.min(spec.time).over(spec.by_series()), F.max(spec.time).over(spec.by_series())
    days, span = 7 * period, 7 * horizon
    bounded = df.withColumns({"__first": first, "__last": last}).withColumn("__end", F.date_sub("__last", span))
    # cutoff = end - i * period with cutoff < time <= cutoff + horizon and cutoff >= first + initial
    ahead = F.datediff("__end", spec.time)
    low = F.greatest(F.lit(0), F.floor(ahead / days) + 1)
    high = F.least(
        F.floor((ahead + span) / days), F.floor((F.datediff("__end", "__first") - 7 * initial) / days)
    )
    steps = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))
    return (
        bounded.withColumn("__i", F.explode(steps))
        .withColumn("cutoff", F.date_sub("__end", F.col("__i") * days))
        .withColumn("horizon_weeks", (F.datediff(spec.time, "cutoff") / 7).cast("int"))
        .drop("__first", "__last", "__end", "__i")
    )


def last_rows(df: DataFrame, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """The latest row of each series."""
    rest = [c for c in df.columns if c not in spec.keys]
    latest = df.groupBy(*spec.keys).agg(F.max_by(F.struct(*rest), F.col(spec.time)).alias("r"))
    return latest.select(*spec.keys, "r.*").select(*df.columns)


def skip_reason(rows, train_rows, test_rows, least: int, folds: int):
    """Status of a group: "ok" or why it cannot be trained."""
    return (
        F.when(rows < least, F.lit("skipped: too few rows"))
        .when(train_rows < folds + 1, F.lit("skipped: too few training rows"))
        .when(test_rows < 1, F.lit("skipped: empty test"))
        .otherwise(F.lit("ok"))
    )
