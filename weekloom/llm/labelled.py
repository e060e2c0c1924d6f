"""Labelled training rows: fold rule, one label per document, and a sample of bounded expected size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the doc_id as text leaves remainder 0; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, target) of labelled documents that are not held out.

    Several labels of one document are averaged; null labels and null doc_ids are left out. Of more than ``most``
    labelled documents a share is taken by a hash of doc_id, so that ``most`` are expected, whatever the table's size.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("target"))
    share = most / max(1, own.count())
    if share >= 1:
        return own
    return own.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 40)) < int(share * (1 << 40)))
