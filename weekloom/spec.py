"""Names and schemas of the tables that make up a set of weekly series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import types as T


@dataclass(frozen=True)
class SeriesSpec:
    """Column roles of a weekly table. One row per (keys, time)."""

    keys: tuple[str, ...] = ("establecimiento", "material")
    time: str = "week"
    value: str = "weekly_volume"
    promo: str = "has_promo"
    period: str = "is_covid_period"
    label: str = "cluster_label"

    @property
    def key_list(self) -> list[str]:
        return list(self.keys)

    def by_series(self) -> WindowSpec:
        """Rows of one series; bounded by the number of weeks in the calendar."""
        return Window.partitionBy(*self.keys)

    def in_time(self) -> WindowSpec:
        return self.by_series().orderBy(self.time)


DEFAULT = SeriesSpec()


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
}


def _struct(text: str) -> T.StructType:
    """Schema from "name type, ..." without needing a session."""
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


BRONZE_RETAILERS = _struct("detallista string, establecimiento string, type string")
BRONZE_SALES = _struct(
    "detallista bigint, material string, calday date, promo_id string, volume_ap double, cantidad_umb bigint"
)
SILVER = _struct(
    "establecimiento string, material string, calday date, promo_id string, "
    "volume_ap double, cantidad_umb bigint, tipo string"
)
GOLD_WEEKLY = _struct(
    "establecimiento string, material string, week date, weekly_volume double, has_promo int, is_covid_period int"
)
GOLD_CLUSTERED = T.StructType([*GOLD_WEEKLY.fields, T.StructField("cluster_label", T.IntegerType())])
SERIES_LABELS = _struct("establecimiento string, material string, cluster_label int")
FORECAST = _struct(
    "establecimiento string, material string, ds date, yhat double, yhat_lower double, yhat_upper double, "
    "trend double, yearly double"
)
CV_RESULTS = _struct(
    "establecimiento string, material string, ds date, cutoff date, y double, yhat double, "
    "yhat_lower double, yhat_upper double"
)
PREDICTIONS = _struct(
    "establecimiento string, material string, week date, actual_volume double, predicted_volume double, "
    "cluster_label int"
)


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Check the schema only; no data is read."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def feature_columns(df: DataFrame, exclude) -> list[str]:
    """All columns of ``df`` but the excluded ones, in table order."""
    drop = set(exclude)
    return [c for c in df.columns if c not in drop]


def split_by_type(df: DataFrame, columns) -> tuple[list[str], list[str]]:
    """Split columns into (numeric, other) by their type."""
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in columns if isinstance(types[c], T.NumericType)]
    return numeric, [c for c in columns if c not in numeric]
