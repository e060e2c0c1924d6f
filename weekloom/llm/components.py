"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.session import stage

ROUNDS = 60


def _least(pairs: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, added to its pairs; hot nodes are counted before the shuffle, split in the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) for all nodes of the edges (a, b); component_id is the smallest node reachable.

    Each round ties every node's larger neighbours to its smallest one, then every node's smaller neighbours. The
    number of rounds grows with the logarithm of the longest path. Every round is written to the shared folder.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = None
    for _ in range(ROUNDS):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        ends = _least(large)
        small = ends.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionAll(ends.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionAll(roots)
