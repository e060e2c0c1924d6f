"""Date expressions on weeks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def monday(date: Column) -> Column:
    """The Monday on or before ``date``."""
    return F.trunc(date, "week")


def week_of_year(date: Column) -> Column:
    """Week number counted from the first Monday of the year, 0 before it (not the ISO week)."""
    return F.floor((F.dayofyear(date) + 6 - F.weekday(date)) / 7).cast("int")


def cycle(position: Column, length: float) -> tuple[Column, Column]:
    """Sine and cosine of a position in a cycle of the given length."""
    angle = F.lit(2 * math.pi) * position / F.lit(float(length))
    return F.sin(angle), F.cos(angle)


def weeks_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start) / F.lit(7.0)
