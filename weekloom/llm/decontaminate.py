"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short, documents long, so a document's own signature says nothing about an item. Items are therefore
partitioned by size; for each partition a document is covered by overlapping windows twice as long as its largest item,
so that every occurrence lies whole in one window of comparable size. Window and item agree in a bin of a one-permutation
signature with a chance that is their similarity there; an item that agrees with a window in any bin is a candidate for the
documents of that window, and is confirmed on the exact share of its shingles that the whole document has.

Items are read in passes of bounded size. Only one pass is on the driver and in the tasks at a time: its hits are stored
before the next one is read. Documents are not shuffled. Items of few shingles keep all of them, so no agreement can be lost
to a bin that another shingle of the window won.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.words import WordHashes, binary, shingles, slices, split
from weekloom.operators.results import union_all
from weekloom.session import stage

WORDS = 5
CONTAINED = 0.8
PASS_BYTES = 16 << 20  # item text of one pass, expected; a larger benchmark takes several passes
GROWTH = 1.5  # largest item of a size partition over its smallest
BIN_BITS = 8
EXACT = 8  # items of at most so many shingles are looked for by each of them
FILTER_BITS = 22
ROW = "__row"
FOUND = "n_items long, item_ids array<long>, most double"
CACHE = WordHashes()


class Partition:
    """Items of similar size and equal shingle length, with their signatures."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]], longest: int):
        self.width, self.longest = width, longest
        values, owners = [], []
        for k, found in items:
            h = np.unique(found)
            first = np.ones(len(h), bool)
            if longest > EXACT:
                first[1:] = (h[1:] >> np.uint64(64 - BIN_BITS)) != (h[:-1] >> np.uint64(64 - BIN_BITS))
            values.append(h[first])
            owners.append(np.full(first.sum(), k))
        v, o = np.concatenate(values), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        self.values, self.owners = v[order], o[order]

    @cached_property
    def filter(self) -> np.ndarray:
        """The low bits that values have; made where it is used, not sent."""
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[self.values & np.uint64((1 << FILTER_BITS) - 1)] = True
        return bits

    def __getstate__(self) -> dict:
        return {name: value for name, value in self.__dict__.items() if name != "filter"}

    def owning(self, own: np.ndarray, place: np.ndarray) -> set[tuple[int, int]]:
        lo, hi = np.searchsorted(self.values, own), np.searchsorted(self.values, own, side="right")
        return {(int(place[i]), int(self.owners[j])) for i in np.nonzero(hi > lo)[0] for j in range(lo[i], hi[i])}

    def candidates(self, h: np.ndarray, valid: np.ndarray) -> set[tuple[int, int]]:
        """(position, item) of agreeing signatures; the position is that of a shingle of the window."""
        maybe = np.nonzero(self.filter[h & np.uint64((1 << FILTER_BITS) - 1)] & valid)[0]
        if not len(maybe):
            return set()
        if self.longest <= EXACT:
            return self.owning(h[maybe], maybe)
        blocks = np.unique(maybe // self.longest)
        starts = np.unique(np.concatenate([blocks, blocks - 1])) * self.longest
        starts = starts[starts >= 0]
        at = starts[:, None] + np.arange(2 * self.longest)[None, :]
        inside = (at < len(h)) & valid[np.minimum(at, len(h) - 1)]
        top = np.uint64(np.iinfo(np.uint64).max)
        window = np.where(inside, h[np.minimum(at, len(h) - 1)], top)
        order = np.argsort(window, axis=1, kind="stable")
        window, at = np.take_along_axis(window, order, 1), np.take_along_axis(at, order, 1)
        least = np.ones(window.shape, bool)
        least[:, 1:] = (window[:, 1:] >> np.uint64(64 - BIN_BITS)) != (window[:, :-1] >> np.uint64(64 - BIN_BITS))
        least &= window != top
        return self.owning(window[least], at[least])


class Index:
    """The items of one pass."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], contained: float):
        self.ids, self.sets, self.contained = [], [], contained
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        longest: dict[tuple[int, int], int] = {}
        for item_id, text in items:
            words = text.lower().split() if text else []
            if not words:
                continue
            found = shingles(CACHE.of(words), WORDS)
            key = (min(WORDS, len(words)), int(np.ceil(np.log(len(found)) / np.log(GROWTH))))
            groups.setdefault(key, []).append((len(self.ids), found))
            longest[key] = max(longest.get(key, 0), len(found))
            self.ids.append(item_id)
            self.sets.append(np.unique(found))
        self.partitions = [Partition(k[0], v, longest[k]) for k, v in sorted(groups.items())]
        self.widths = sorted({p.width for p in self.partitions})

    def search(self, texts: list[bytes | None]) -> list[list[tuple[int, float]]]:
        """For each text: the items it holds and the share of their shingles."""
        words, ends = split(texts, lowered=True)
        hashes = CACHE.of(words)
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        for width in self.widths:
            if len(hashes) < width:
                continue
            h = shingles(hashes, width)
            valid = owner[: len(h)] == owner[width - 1 :]
            pairs = set()
            for p in self.partitions:
                if p.width == width:
                    pairs |= {(int(owner[at]), item) for at, item in p.candidates(h, valid)}
            for doc, item in sorted(pairs):
                own = h[ends[doc] : max(ends[doc], ends[doc + 1] - width + 1)]
                share = float(np.isin(self.sets[item], own).mean())
                if share >= self.contained:
                    out[doc].append((item, share))
        return out


def _search(index: Index):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = index.search(binary(part.column("text")))
                ids = [sorted(index.ids[i] for i, _ in f if index.ids[i] is not None) for f in found]
                n = pa.array([len(f) for f in found], pa.int64())
                most = pa.array([max((s for _, s in f), default=0.0) for f in found], pa.float64())
                yield pa.record_batch(
                    [*(part.column(c) for c in part.schema.names if c != "text"), n, pa.array(ids, pa.list_(pa.int64())), most],
                    [*(c for c in part.schema.names if c != "text"), "n_items", "item_ids", "most"],
                )

    return search


def indexes(benchmark: DataFrame, contained: float, pass_bytes: int) -> tuple[int, Iterator[Index]]:
    """The number of passes and their items; a pass is read when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))

    def read() -> Iterator[Index]:
        for k in range(passes):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else items
            yield Index([(r.item_id, None if r.text is None else r.text.encode()) for r in rows.collect()], contained)

    return passes, read()


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, written once, so that every pass sees the same keys."""
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _hits(rows: DataFrame, found: Iterator[Index]) -> DataFrame:
    """The items of all passes, for the rows that hold any, by key; each pass is stored before the next one is read."""
    texts = rows.select(ROW, F.col("text").cast("string").alias("text"))
    stored = []
    for index in found:
        stored.append(stage(texts.mapInArrow(_search(index), f"{ROW} long, {FOUND}").where("n_items > 0")))
    ids = F.array_sort(F.flatten(F.collect_list("item_ids")))
    hits = union_all(stored).groupBy(ROW)
    return hits.agg(F.sum("n_items").alias("n_items"), ids.alias("item_ids"), F.max("most").alias("most"))


def contamination(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending) and most of every row of (doc_id, text).

    An item of (item_id, text) is in a document if the document's set of 5-word shingles (A-Z lower-cased) has at least
    the share ``contained`` of the item's; an item of fewer words is one shingle, looked for as a run of words. most is
    the largest such share. Null and empty items are in no document, null and empty documents hold none. Repeated items
    count each; an item without an item_id counts but isn't named. Every row is judged by its own text, whatever the number
    of passes and also where rows share a doc_id or have none. Extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes, found = indexes(benchmark, contained, pass_bytes)
    if passes == 1:
        done = docs.mapInArrow(_search(next(found)), f"doc_id long, {FOUND}")
    else:
        rows = _keyed(docs)
        done = rows.select("doc_id", ROW).join(_hits(rows, found), ROW, "left").select(
            "doc_id",
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
            F.coalesce("most", F.lit(0.0)).alias("most"),
        )
    return done.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_ids", "most")


def cleaned(docs: DataFrame, benchmark: DataFrame, contained: float = CONTAINED, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows that hold no item, with all their columns; defined as in ``contamination``."""

    def kept(index: Index):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    yield part.filter(pa.array([not f for f in index.search(binary(part.column("text")))], pa.bool_()))

        return keep

    passes, found = indexes(benchmark, contained, pass_bytes)
    if passes == 1:
        return docs.mapInArrow(kept(next(found)), docs.schema)
    for index in found:  # a pass judges what the ones before it kept
        docs = stage(docs.mapInArrow(kept(index), docs.schema))
    return docs
