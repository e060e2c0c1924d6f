"""Null-safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is NULL or 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clamp(value: Column, low: float = 0.0) -> Column:
    return F.greatest(F.lit(low), value)


def is_bad(value: Column) -> Column:
    """True for NaN and both infinities."""
    return F.isnan(value) | value.isin(float("inf"), float("-inf"))


def positive(value: Column) -> Column:
    """The value where it is above zero, else NULL."""
    return F.when(value > 0, value)


def portable_hash(columns, seed: int) -> Column:
    """Hex digest that any SQL engine can reproduce, for sampling without random numbers."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))
