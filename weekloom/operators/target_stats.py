"""Category encodings whose dictionaries stay distributed: codes, and target statistics in the order of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.lookup import null_safe_join, prefix_totals, spread_join
from weekloom.spec import DEFAULT, SeriesSpec

PREFIX = "ts_"
PRIOR_ROWS = 10.0  # rows of the group's mean that each category starts with
MISSING = "missing"


def category(name: str, missing: str = MISSING) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(missing))


def category_codes(df: DataFrame, column: str, missing: str = MISSING) -> DataFrame:
    """(category, rows, code): categories numbered from 0, the most frequent first, equal ones in order.

    The numbers come from a running total over buckets of the row counts, so no task and no driver holds the list.
    """
    counts = df.groupBy(category(column, missing).alias("category")).agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("__down", -F.col("rows"))
    levels = [F.col("__down"), F.substring("category", 1, 2), F.substring("category", 1, 6)]
    placed = prefix_totals(counts, [], ["__down", "category"], {"__n": F.lit(1)}, levels)
    return placed.select("category", "rows", F.col("__n_before").cast("long").alias("code"))


def with_codes(df: DataFrame, codes: DataFrame, column: str, name: str, missing: str = MISSING) -> DataFrame:
    """Adds the code of a column; a category that the table lacks has code -1.

    The table may have as many rows as the data, so it is not repeated: both sides are joined by hash, and the adaptive
    planner splits a frequent category's rows.
    """
    table = codes.select(F.col("category").alias("__category"), F.col("code").alias("__code"))
    joined = df.withColumn("__category", category(column, missing)).join(table, "__category", "left")
    return joined.withColumn(name, F.coalesce("__code", F.lit(-1).cast("long"))).drop("__category", "__code")


def ordered_target_statistics(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    group: Sequence[str] | None = None,
    prior_rows: float = PRIOR_ROWS,
    until: str | None = None,
    missing: str = MISSING,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Adds ts_COLUMN: the mean target of the column's category in its group, from rows of earlier dates only.

    It is (sum + prior_rows * prior) / (count + prior_rows) over earlier dates; prior is the mean of all earlier rows of the
    group, 0 where there are none. So a category that has not been seen has the prior, and no row sees its own target or
    one of its date: one pass serves all folds in time order at once, and nothing is fitted per fold. A null target counts
    as no row, so rows to predict can stand in the table. ``until`` names a boolean column: dates from the first one of a
    group at which it is false add nothing (a test whose targets are not known in between).

    Sums are taken per (group, category, date), partly before the shuffle; a category's prefix sum has as many rows as
    there are dates. The table of categories is joined by hash and never collected; a frequent category is spread.
    """
    columns = spec.key_list if columns is None else list(columns)
    group = [spec.label] if group is None else list(group)
    target, time = F.col(spec.value).cast("double"), spec.time
    named = df.withColumns({f"__c_{c}": category(c, missing) for c in columns})
    counted = named
    if until is not None:
        ends = df.filter(~F.coalesce(F.col(until), F.lit(False))).groupBy(*group).agg(F.min(time).alias("__end"))
        counted = spread_join(named, ends, group)
        target = F.when(F.col("__end").isNull() | (F.col(time) < F.col("__end")), target)
    counted = counted.withColumn("__y", target)
    sums = [F.sum("__y").alias("__s"), F.count("__y").cast("double").alias("__n")]

    def before(keys: list[str], total: str, name: str) -> Column:
        dates = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(time)
        return F.coalesce(F.sum(total).over(dates.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias(name)

    whole = counted.groupBy(*group, time).agg(*sums)
    prior = whole.select(*group, time, before(group, "__s", "__s"), before(group, "__n", "__n"))
    prior = prior.select(*group, time, F.when(F.col("__n") > 0, F.col("__s") / F.col("__n")).otherwise(0.0).alias("__prior"))
    out = spread_join(named, prior, [*group, time])
    for c in columns:
        keys = [*group, f"__c_{c}"]
        dated = counted.groupBy(*keys, time).agg(*sums)
        earlier = dated.select(*keys, time, before(keys, "__s", "__s"), before(keys, "__n", "__n"))
        out = null_safe_join(out, earlier, [*keys, time])
        value = (F.col("__s") + F.lit(prior_rows) * F.col("__prior")) / (F.col("__n") + F.lit(prior_rows))
        out = out.withColumn(f"{PREFIX}{c}", value).drop("__s", "__n")
    return out.select(*df.columns, *[f"{PREFIX}{c}" for c in columns])


def statistics_for(
    rows: DataFrame,
    history: DataFrame,
    columns: Sequence[str] | None = None,
    group: Sequence[str] | None = None,
    prior_rows: float = PRIOR_ROWS,
    missing: str = MISSING,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """``rows`` with the target statistics that ``history``, a table of (keys, group, date, target), gives at their dates.

    The targets of ``rows`` themselves are not looked at, so several weeks to predict see the same history.
    """
    columns = spec.key_list if columns is None else list(columns)
    group = [spec.label] if group is None else list(group)
    needed = list(dict.fromkeys([*columns, *group, spec.time, spec.value]))
    row = F.struct(*[F.col(c).alias(c) for c in rows.columns])
    kind = dict(history.dtypes)[spec.value]
    asked = rows.select(*[F.lit(None).cast(kind).alias(c) if c == spec.value else F.col(c) for c in needed], row.alias("__row"))
    told = history.select(*needed, F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"))
    found = ordered_target_statistics(told.unionByName(asked), columns, group, prior_rows, missing=missing, spec=spec)
    return found.filter(F.col("__row").isNotNull()).select("__row.*", *[f"{PREFIX}{c}" for c in columns])
