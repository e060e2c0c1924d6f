"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors are one class first and go on once, with their number. Centroids are fitted on a sample of bounded size and
sent to all tasks (at most ``MOST_CELLS`` vectors). Every class lives in the cell of its nearest centroid, in a block of
bounded size, and also visits the blocks of each cell that may hold a vector similar enough: one whose border, the plane
midway between the two centroids, is at most the angle asked for away. Beyond it no link is possible, so none is missed.
Every pair of blocks is one group: a matrix product in double precision. A group returns counts of links per vector and a
spanning forest of its links, never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.components import components
from weekloom.session import stage

FIT_ROWS = 20_000  # vectors that the centroids are fitted on, expected
MOST_CELLS = 512
BLOCK = 4096
ROWS = 512  # rows of a matrix product held at one time
ROUNDING = 1e-6  # added to the margin of a border
SIMILAR = 0.9
ROUNDS = 12


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of norm 1 in double precision; scaled first, so that very large or small components stay finite."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spherical_kmeans(points: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors."""
    rng = np.random.default_rng(5)
    centres = points[np.sort(rng.choice(len(points), min(cells, len(points)), replace=False))].copy()
    for _ in range(ROUNDS):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors that can link, as bytes of doubles."""
    for batch in batches:
        keys = []
        for v in batch.column("embedding").to_pylist():
            a = np.array([np.nan if x is None else x for x in v], np.float64) if v else np.zeros(0)
            keys.append((a + 0.0).tobytes() if len(a) and np.isfinite(a).all() and a.any() else None)
        yield pa.record_batch([batch.column("vec_id"), pa.array(keys, pa.binary())], ["vec_id", "vector"])


def margins(centres: np.ndarray, similar: float) -> np.ndarray:
    """How much nearer than each other centroid a vector's own may be, if a vector of that cell can be ``similar``.

    The plane midway between unit centroids c and d passes the origin. A vector x on c's side is at the angle
    arcsin(x (c - d) / |c - d|) from it, and every vector of d's cell is on or beyond it.
    """
    if similar <= 0:
        return np.full((len(centres), len(centres)), np.inf)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ centres.T)))
    return np.sqrt(max(0.0, 1 - similar * similar)) * apart + ROUNDING


def places(units: np.ndarray, centres: np.ndarray, margin: np.ndarray, visit: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The home cell of each vector, and whether it goes to each cell."""
    near = units @ centres.T
    home = near.argmax(axis=1)
    return home, near.max(axis=1, keepdims=True) - near <= np.maximum(margin[home], visit)


def _cells(centroids: dict[int, np.ndarray], similar: float, visit: float):
    """The home cell and all cells to go to; vectors of different length never share a cell."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = {d: margins(c, similar) for d, c in centroids.items()}
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            width = np.array([len(x) // 8 for x in raw])
            for d in np.unique(width):
                rows = np.nonzero(width == d)[0]
                units = unit_rows(np.frombuffer(b"".join(raw[i] for i in rows), np.float64).reshape(-1, d))
                if int(d) in centroids:
                    home, go = places(units, centroids[int(d)], margin[int(d)], visit)
                else:
                    home, go = np.zeros(len(rows), np.int64), np.ones((len(rows), 1), bool)
                picked = batch.take(pa.array(rows))
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(rows), d), pa.int32()),
                        pa.array(home, pa.int32()),
                        pa.array([np.nonzero(x)[0] for x in go], pa.list_(pa.int32())),
                        *(picked.column(c) for c in ("rep", "copies", "vector")),
                    ],
                    ["width", "home", "cells", "rep", "copies", "vector"],
                )

    return assign


def _link(similar: float):
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("tied", pa.int64())])

    def link(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = ((k["cell"].as_py(), k["block"].as_py()) for k in key[1:])
        table = table.sort_by("rep")
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        home, block = table.column("home").to_numpy(), table.column("block").to_numpy()
        left, right = (np.nonzero((home == c) & (block == b))[0] for c, b in (lo, hi))
        if not len(left) or not len(right):
            return schema.empty_table()
        units = unit_rows(np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(ids), -1))
        count = np.zeros(len(ids), np.int64)
        tied = np.arange(len(ids))  # the smallest row reachable by links of this group
        others = np.ascontiguousarray(units[right].T)
        for start in range(0, len(left), ROWS):
            own = left[start : start + ROWS]
            close = units[own] @ others >= similar
            if lo == hi:
                close = np.triu(close, start + 1)
            for i in np.nonzero(close.any(axis=1))[0]:
                met = right[close[i]]
                count[own[i]] += copies[met].sum()
                count[met] += copies[own[i]]
                parts = np.unique(np.append(tied[met], tied[own[i]]))
                if len(parts) > 1:
                    tied[np.isin(tied, parts)] = parts[0]
        use = np.nonzero(count)[0]
        return pa.table([pa.array(ids[use]), pa.array(count[use]), pa.array(ids[tied[use]])], schema=schema)

    return link


def near_vectors(
    vectors: DataFrame, similar: float = SIMILAR, visit: float = 0.0, most_cells: int = MOST_CELLS, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding).

    Linked are vectors of equal length with a cosine of ``similar`` or more in double precision. Null, empty and zero
    vectors, and those with null or non-finite components, link with nothing: 0 links, their own component. Equal vectors
    link with each other; rows that repeat a vec_id count like any others. component_id is the smallest vec_id reachable,
    kept is vec_id = component_id. A null vec_id links with nothing, has no component and is kept. Extra columns are
    ignored; an empty table gives no rows. All links are found: the cells only spare comparisons that cannot link. ``visit`` widens
    the borders beyond that, without changing the result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    valid = stage(rows.mapInArrow(_valid, "vec_id long, vector binary"))
    known = valid.where("vec_id IS NOT NULL AND vector IS NOT NULL")
    classes = stage(known.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))

    total = classes.count()
    share = min(1.0, FIT_ROWS / max(1, total))
    sample = classes.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("rep").select("vector")
    by_width: dict[int, list[np.ndarray]] = {}
    for r in sample.collect():  # about FIT_ROWS vectors at most
        v = np.frombuffer(bytes(r.vector), np.float64)
        by_width.setdefault(len(v), []).append(v)
    cells = max(1, min(most_cells, -(-total // block)))
    centroids = {d: spherical_kmeans(unit_rows(np.array(v)), cells) for d, v in by_width.items()}

    placed = classes.mapInArrow(
        _cells(centroids, similar, visit), "width int, home int, cells array<int>, rep long, copies long, vector binary"
    )
    placed = stage(placed)
    sizes = placed.groupBy("width", "home").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = placed.join(sizes, ["width", "home"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("blocks")
    sizes = sizes.withColumnRenamed("home", "cell")
    dealt = dealt.withColumn("cell", F.explode("cells")).drop("cells").join(sizes, ["width", "cell"])
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own = F.struct(F.col("home").alias("cell"), "block")
    met = F.struct("cell", F.col("other").alias("block"))
    dealt = dealt.select("width", F.least(own, met).alias("lo"), F.greatest(own, met).alias("hi"), "home", "block", "rep", "copies", "vector")
    linked = dealt.groupBy("width", "lo", "hi").applyInArrow(_link(similar), "rep long, links long, tied long")
    linked = stage(linked)
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(linked.select(F.col("rep").alias("a"), F.col("tied").alias("b")).where("a <> b"))

    found = classes.join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select(
        "vector",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    named = valid.withColumn("vector", F.when(F.col("vec_id").isNotNull(), F.col("vector"))).join(found, "vector", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return named.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
