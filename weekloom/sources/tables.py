"""Reading and writing the tables of the layers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.settings import FORECAST_COLUMNS
from weekloom.spec import DEFAULT, SeriesSpec, require_columns


def read_parquet(
    spark: SparkSession, path: str, columns: Iterable[str] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Parquet scan; the column list reaches the scan, and so do filters put on the result."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*require_columns(df, columns)[list(columns)].columns) if columns else df


def read_label(spark: SparkSession, path: str, label: int, spec: SeriesSpec = DEFAULT) -> DataFrame:
    """Rows of one cluster; reads only its folder if the table was written by ``write_by_label``."""
    return spark.read.parquet(path).filter(F.col(spec.label) == label)


def read_schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(path).schema


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", compression).partitionBy(*partition_by).parquet(path)


def write_by_label(df: DataFrame, path: str, spec: SeriesSpec = DEFAULT) -> None:
    """One folder per cluster, sorted by series and week inside the files.

    Rows are spread by series rather than by label, so that a large cluster is written by many tasks.
    """
    (
        df.repartition(*spec.keys)
        .sortWithinPartitions(spec.label, *spec.keys, spec.time)
        .write.mode("overwrite")
        .partitionBy(spec.label)
        .parquet(path)
    )


def replace_labels(df: DataFrame, path: str, format: str = "parquet", spec: SeriesSpec = DEFAULT) -> None:
    """Write the result rows of some clusters and keep those of the others."""
    (
        df.write.mode("overwrite")
        .format(format)
        .option("partitionOverwriteMode", "dynamic")
        .option("header", "true")
        .partitionBy(spec.label)
        .save(path)
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; ``mode="append"`` adds rows to an existing folder."""
    df.write.mode(mode).option("header", "true").csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def register(df: DataFrame, name: str) -> DataFrame:
    """Make the table known to SQL under a name."""
    df.createOrReplaceTempView(name)
    return df


def write_forecasts(df: DataFrame, path: str, spec: SeriesSpec = DEFAULT) -> None:
    """Forecasts of all series in one table, with those of the usual columns that are there."""
    columns = [c for c in FORECAST_COLUMNS if c in df.columns]
    (
        df.select(*spec.keys, *columns)
        .repartition(*spec.keys)
        .sortWithinPartitions(*spec.keys, "ds")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(spec.keys[0])
        .parquet(path)
    )
