"""What was known at a cutoff: regressors and actuals joined to the rows of a forecast, never from later than the cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.spec import DEFAULT, SeriesSpec

CUTOFF, DATE = "cutoff", "ds"


def planned_regressors(
    frame: DataFrame,
    facts: DataFrame,
    values: Sequence[str],
    known_since: str | None = None,
    fill: float = 0,
    cutoff: str = CUTOFF,
    date: str = DATE,
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Adds ``values`` of the series and date of each frame row, as they were known at its cutoff, and ``is_known``.

    ``frame`` has the series' keys, a date and a cutoff; ``facts`` the keys, the date (``spec.time``), the values and in
    ``known_since`` the date from which on they are known: without it a fact is known from its own date on, so that
    nothing after the cutoff is seen. Of several versions of a fact the latest one known counts, of equally late ones the
    largest. Rows whose fact is not known get ``fill``; rows without a cutoff, date or key know nothing.

    Series are joined by hash on keys and date; a fact meets the cutoffs of its own date only.
    """
    values = list(values)
    since = F.col(known_since) if known_since else F.col(spec.time)
    version = F.struct(since.alias("since"), F.struct(*[F.col(v).alias(v) for v in values]).alias("v"))
    told = facts.select(*spec.keys, F.col(spec.time).alias("__date"), version.alias("__fact"))
    asked = frame.select(*spec.keys, F.col(date).alias("__date"), F.col(cutoff).alias("__cutoff")).distinct()
    seen = (
        asked.join(told, [*spec.keys, "__date"])
        .filter(F.col("__fact.since") <= F.col("__cutoff"))
        .groupBy(*spec.keys, "__date", "__cutoff")
        .agg(F.max("__fact").alias("__fact"))
    )
    named = frame.withColumns({"__date": F.col(date), "__cutoff": F.col(cutoff)})
    joined = named.join(seen, [*spec.keys, "__date", "__cutoff"], "left")
    kinds = dict(facts.dtypes)
    known = F.col("__fact").isNotNull()
    out = {v: F.coalesce(F.col(f"__fact.v.{v}"), F.lit(fill).cast(kinds[v])) for v in values}
    return joined.withColumns({**out, "is_known": known}).select(*frame.columns, *values, "is_known")


def last_known(
    frame: DataFrame,
    facts: DataFrame,
    values: Sequence[str],
    cutoff: str = CUTOFF,
    date: str = DATE,
    prefix: str = "last_",
    spec: SeriesSpec = DEFAULT,
) -> DataFrame:
    """Adds last_VALUE from the latest fact up to the row's cutoff and date, and ``last_date``; null where there is none.

    Facts are known at their own date. A row looks back from the earlier one of its date and its cutoff, so facts and
    rows are put in one order per series, and each row takes the last fact before it: one shuffle by series, no pairs.
    Of several facts of one date the largest counts.
    """
    values = list(values)
    fact = F.struct(F.col(spec.time).alias("d"), F.struct(*[F.col(v).alias(v) for v in values]).alias("v"))
    told = facts.select(*spec.keys, F.col(spec.time).alias("__at"), fact.alias("__fact"))
    told = told.filter(F.col("__at").isNotNull()).groupBy(*spec.keys, "__at").agg(F.max("__fact").alias("__fact"))
    row: Column = F.struct(*[F.col(c).alias(c) for c in frame.columns])
    asked = frame.select(*spec.keys, F.when(F.col(date) < F.col(cutoff), F.col(date)).otherwise(F.col(cutoff)).alias("__at"), row.alias("__row"))
    both = told.select("*", F.lit(None).cast(asked.schema["__row"].dataType).alias("__row")).unionByName(
        asked.select("*", F.lit(None).cast(told.schema["__fact"].dataType).alias("__fact"))
    )
    # A row without a date or cutoff stands before all facts and finds none; of one date the fact comes first.
    before = spec.by_series().orderBy(F.col("__at").asc_nulls_first(), F.col("__row").isNotNull())
    found = F.last("__fact", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__fact", found).filter(F.col("__row").isNotNull())
    return out.select("__row.*", *[F.col(f"__fact.v.{v}").alias(f"{prefix}{v}") for v in values], F.col("__fact.d").alias(f"{prefix}date"))


def leaks(joined: DataFrame, used: str, cutoff: str = CUTOFF) -> DataFrame:
    """The rows of a joined frame whose date ``used`` lies after their cutoff."""
    return joined.filter(F.col(used) > F.col(cutoff))


def without_leaks(joined: DataFrame, used: str, cutoff: str = CUTOFF) -> DataFrame:
    """``joined``, whose reading fails at the first row that uses a date after its cutoff: no leak gets past unseen."""
    message = F.concat(F.lit(f"{used} "), F.col(used).cast("string"), F.lit(" lies after the cutoff "), F.col(cutoff).cast("string"))
    checked = F.when(F.col(used) > F.col(cutoff), F.raise_error(message).cast(dict(joined.dtypes)[used])).otherwise(F.col(used))
    return joined.withColumn(used, checked)
