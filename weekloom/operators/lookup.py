"""Joins and running totals that stay balanced when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.session import fix

LOOKUP_ROWS = 100_000
SALTS = 64
ROWS_PER_TASK = 1_000_000


def bounded(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame | None:
    """``df`` as a local table if it has at most ``limit`` rows, else None.

    At most ``limit + 1`` rows ever reach the driver, whatever the size of ``df``.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = LOOKUP_ROWS, salts: int = SALTS
) -> DataFrame:
    """Join a table of per-group values to the rows of the groups.

    Broadcast only when the counted size allows it. Otherwise the small side is repeated once per salt, so that
    the rows of a hot group are spread over ``salts`` tasks instead of one.
    """
    local = bounded(small, limit)
    if local is not None:
        return big.join(F.broadcast(local), on, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*on, "__salt"], how).drop("__salt")


def running_total(
    df: DataFrame, group: list[str], order: list[str], weight: Column, before: str = "__before", total: str = "__total"
) -> DataFrame:
    """Add to each row the weight of all earlier rows of its group, and of the whole group.

    A window over the group would put it into one task. Here the rows are range-partitioned by (group, order),
    which cuts big groups into several sorted blocks; only the block sums, as many as there are partitions, are
    added up across blocks. The block of a row must not change between the two uses, so the ranges are fixed first.
    """
    ranged = (
        df.withColumn("__weight", weight)
        .repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*group, *order]])
        .withColumn("__block", F.spark_partition_id())
    )
    ranged = fix(ranged)
    per_block = ranged.groupBy(*group, "__block").agg(F.sum("__weight").alias("__block_weight"))
    groups = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier_blocks = groups.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(
        *group,
        "__block",
        F.coalesce(F.sum("__block_weight").over(earlier_blocks), F.lit(0)).alias("__block_start"),
        F.sum("__block_weight").over(groups).alias(total),
    )
    earlier_rows = Window.partitionBy(*group, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # NULL group values must meet their own block, hence the null-safe comparison.
    ranged = ranged.alias("r")
    per_block = per_block.alias("b")
    match = F.col("r.__block") == F.col("b.__block")
    for c in group:
        match = match & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
    joined = ranged.join(per_block, match).select("r.*", "b.__block_start", f"b.{total}")
    within = F.coalesce(F.sum("__weight").over(earlier_rows), F.lit(0))
    return joined.withColumn(before, F.col("__block_start") + within).drop("__block", "__block_start", "__weight")


def task_count(table: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int | None:
    """Partitions for a shuffle of the rows of a stored table, one per ``rows_per_task``; None if the cores alone make more.

    With None a join is left to Spark, which may then broadcast a side. Rows of Parquet are counted from the footers.
    """
    parts = -(-table.count() // rows_per_task)
    return parts if parts > table.sparkSession.sparkContext.defaultParallelism else None


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys where NULL meets NULL; the columns of ``left``, then the others of ``right``."""
    a, b = left.alias("__a"), right.alias("__b")
    match = F.lit(True)
    for c in on:
        match = match & F.col(f"__a.`{c}`").eqNullSafe(F.col(f"__b.`{c}`"))
    rest = [F.col(f"__b.`{c}`") for c in right.columns if c not in on]
    return a.join(b, match, how).select("__a.*", *rest)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join a table of per-group values to the rows of the groups, without looking at either side first.

    The small side is repeated once per salt, so that a hot group is spread whatever the sizes turn out to be; the
    adaptive planner still broadcasts it if its measured size allows that. Building the plan starts no job.
    """
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    repeated = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(salted, repeated, [*on, "__salt"], how).drop("__salt")


def prefix_totals(
    df: DataFrame, group: list[str], order: list[str], weights: dict[str, Column], levels: list[Column]
) -> DataFrame:
    """``running_total`` of several weights as one plan: NAME_before and NAME_total for each of them.

    ``levels`` are buckets of the order, coarse to fine, that keep it: a row in a smaller bucket comes first. They are
    functions of the row and not of a sample, so the plan gives the same buckets whenever it runs, nothing has to be
    stored, and building it starts no job. Sums per bucket are added up over the buckets of the level above; rows are
    only ordered inside the finest bucket, so a hot group is spread over its buckets.
    """
    names = [f"__level_{i}" for i in range(len(levels))]
    base = df.withColumns(dict(zip(names, levels, strict=True))).withColumns({f"__w_{k}": w for k, w in weights.items()})
    finest = base.groupBy(*group, *names).agg(*[F.sum(f"__w_{k}").alias(f"__w_{k}") for k in weights])

    def over(keys: list[str]):
        return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))

    def earlier(window, k: str) -> Column:
        return F.coalesce(F.sum(f"__w_{k}").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    places = None
    for i in range(len(names), 0, -1):
        keys = [*group, *names[:i]]
        sums = finest if i == len(names) else finest.groupBy(*keys).agg(*[F.sum(f"__w_{k}").alias(f"__w_{k}") for k in weights])
        window = over(keys[:-1])
        own = {f"__b{i}_{k}": earlier(window.orderBy(names[i - 1]), k) for k in weights}
        if i == 1:
            own |= {f"{k}_total": F.sum(f"__w_{k}").over(window) for k in weights}
        sums = sums.select(*keys, *[c.alias(n) for n, c in own.items()])
        places = sums if places is None else null_safe_join(places, sums, keys)
    rows = null_safe_join(base, places, [*group, *names])
    inside = over([*group, *names]).orderBy(*order)
    found = rows.withColumns(
        {f"{k}_before": sum((F.col(f"__b{i}_{k}") for i in range(1, len(names) + 1)), earlier(inside, k)) for k in weights}
    )
    return found.select(*df.columns, *[f"{k}_{end}" for k in weights for end in ("before", "total")])


def number_levels(name: str) -> list[Column]:
    """Buckets of a column of doubles without null and NaN: sign and exponent, then twice ten more binary digits."""
    v = F.col(name)
    size = F.abs(v)
    finite = (size < F.lit(float("inf"))) & (size > F.lit(2.0**-1000))
    exponent = F.when(finite, F.floor(F.log2(F.when(finite, size).otherwise(F.lit(1.0)))).cast("int"))
    height = F.when(size == F.lit(float("inf")), F.lit(1100)).otherwise(F.coalesce(exponent, F.lit(-1001))) + 2000
    first = F.when(v > 0, height).when(v < 0, -height).otherwise(F.lit(0))

    def digits(n: int) -> Column:
        scaled = F.when(finite, v * F.pow(F.lit(2.0), F.lit(n // 2) - exponent) * F.lit(2.0 ** (n - n // 2)))
        return F.coalesce(F.floor(scaled), F.lit(0).cast("long"))

    return [first, digits(10), digits(20)]
