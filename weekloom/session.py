"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


# For any session that builds feature tables: the JVM does not compile methods of more than 8000 bytes of bytecode,
# and one fused stage over some fifty derived columns is larger. Below this limit Spark splits it into small methods.
WIDE_TABLE_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the settings for wide tables on a session that already exists, such as that of a cluster."""
    for key, value in WIDE_TABLE_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weekloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small tables with costly rows: keep all cores busy instead of merging partitions by their bytes.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in WIDE_TABLE_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing a temporary folder is used, but only in local mode: on a cluster it would
    vanish together with its executor.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="weekloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fix(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder, so that later reads see the very same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Unlike a checkpoint the copy is columnar, and ``partition_by`` makes later equality filters skip files.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/weekloom-stage-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def workers_find_package(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package from where it lies.

    On a cluster the package is installed or passed with ``--py-files``, as any other code of a job.
    """
    context = spark.sparkContext
    home = str(Path(__file__).parent.parent)
    known = context.environment.get("PYTHONPATH", "")
    if context.master.startswith("local") and home not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(p for p in (known, home) if p)


def in_parallel(spark: SparkSession, work: Sequence[Callable], threads: int) -> list:
    """Run independent Spark jobs side by side, so that the tail of one does not idle the cluster."""
    if threads <= 1 or len(work) <= 1:
        return [w() for w in work]
    with ThreadPool(threads) as pool:
        return pool.map(lambda w: inheritable_thread_target(spark)(w)(), work)
