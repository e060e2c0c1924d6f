"""Samples that are the same on every run and every partitioning: rows are chosen by a hash of their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.functions.numeric import portable_hash
from weekloom.operators.lookup import lookup_join, spread_join
from weekloom.operators.results import union_all
from weekloom.session import stage
from weekloom.settings import SAMPLE_FLOOR, SAMPLE_FRACTION, SEED
from weekloom.spec import DEFAULT, SeriesSpec

LEVELS = 7  # of four hexadecimal digits each, out of 32
ORDERED_ROWS = 10_000


def _bucket(digest, level: int = 0):
    return F.conv(F.substring(digest, 1 + 4 * level, 4), 16, 10).cast("int")


def _below(digest, fraction: float):
    """True for a share of the digests, told apart by their first 60 bits."""
    if fraction >= 1:
        return F.lit(True)
    return F.substring(digest, 1, 15) < F.lit(f"{int(max(fraction, 0.0) * 16**15):015x}")


def sample_fraction(df: DataFrame, fraction: float, seed: int = SEED, spec: SeriesSpec = DEFAULT) -> DataFrame:
    digest = portable_hash([*spec.keys, spec.time], seed)
    return df.filter(_below(digest, fraction))


def sample_large_groups(
    df: DataFrame,
    fraction: float = SAMPLE_FRACTION,
    floor: int = SAMPLE_FLOOR,
    seed: int = SEED,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Sample only the groups whose sample would have more than ``floor`` rows; keep the others whole."""
    sizes = df.groupBy(spec.label).agg(F.count(F.lit(1)).alias("__rows"))
    digest = portable_hash([*spec.keys, spec.time], seed)
    chosen = _below(digest, fraction)
    small = F.col("__rows") * F.lit(fraction) <= floor
    return lookup_join(df, sizes, [spec.label]).filter(small | chosen).select(*df.columns)


def sample_rows(
    df: DataFrame,
    rows: int,
    seed: int = SEED,
    spec: SeriesSpec = DEFAULT,
    group: list[str] | None = None,
    ordered: int = ORDERED_ROWS,
) -> DataFrame:
    """Exactly ``rows`` rows of each group (all of a smaller one): those with the lowest hashes.

    Rows are counted per first digits of the hash. Whole buckets below the limit are taken as they are; the one bucket that
    crosses it, a 65536th of the group, is split by its next digits, and so on, until the rows that still cross are at
    most ``ordered`` in every group. Only these are put in order, so the table may be one group. Rows with equal keys
    have one hash, which no digits split.
    """
    group = [spec.label] if group is None else group
    open_ = df.withColumns({"__hash": portable_hash([*spec.keys, spec.time], seed), "__need": F.lit(rows).cast("long")})
    taken = []
    for level in range(LEVELS):
        bucket = _bucket(F.col("__hash"), level)
        open_ = open_.withColumn("__bucket", bucket)
        per_bucket = open_.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.first("__need").alias("__rows"))
        upward = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("__bucket")
        filled = per_bucket.withColumn("__up_to", F.sum("__n").over(upward))
        crossing = F.struct("__bucket", (F.col("__up_to") - F.col("__n")).alias("below"), F.col("__n").alias("n"))
        crossed = F.col("__up_to") >= F.col("__rows")
        limits = filled.groupBy(*group).agg(F.min(F.when(crossed, crossing)).alias("__limit"))
        limits = stage(limits.select(*group, "__limit.*").toDF(*group, "__last", "__below", "__crossing"))
        placed = spread_join(open_, limits, group, "inner")
        whole = F.col("__last").isNull() | (F.col("__bucket") < F.col("__last"))
        taken.append(placed.filter(whole).select(*df.columns))
        rest = placed.filter(F.col("__bucket") == F.col("__last")).withColumn("__need", F.col("__need") - F.col("__below"))
        # A few rows of each group: later levels read these instead of the table.
        open_ = stage(rest.select(*df.columns, "__hash", "__need"))
        if (limits.agg(F.max("__crossing")).first()[0] or 0) <= ordered:
            break
    window = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    place = F.row_number().over(window.orderBy("__hash", *spec.keys, spec.time))
    part = open_.withColumn("__place", place).filter(F.col("__place") <= F.col("__need")).select(*df.columns)
    return union_all([*taken, part])
