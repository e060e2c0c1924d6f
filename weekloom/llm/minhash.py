"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

1. One pass over the texts gives each document its set size, a key of its set of word shingles and its band keys. Sets are
   hashed once (one permutation); a bin without a shingle borrows from bins drawn by a fixed sequence until it meets a
   full one. Documents with equal sets are one class, found by their key, and go on as one node with the text of one
   representative. Classes that share a doc_id are tied like linked ones.
2. Band keys are buckets. The smallest representative of a bucket is its centre; only centre-member edges are made, so
   the number of candidates is at most bands times classes.
3. The texts of all members of buckets are gathered once. Candidates are confirmed on full sets of shingles: each member's
   text is sent to the blocks of its centres.
4. Confirmed edges give components. A bucket that still holds several components may hide links between members whose
   centre they don't match. Only such buckets go on, without their centre, which has met everyone, and one of several with
   the same members. Its largest component is dealt into blocks, and so are all its other members; whole sets of
   hashes meet block by block, largest against others and others against each other, so that members of the largest
   component never meet. Decisions are exact there, and a group returns a forest of true links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.components import components
from weekloom.llm.words import GOLDEN, WordHashes, binary, mix, shingles, slices
from weekloom.session import stage

BANDS, ROWS = 25, 5  # a pair at similarity 0.85 meets in no bucket with a chance of (1 - 0.85**5)**25 = 4e-7
BINS = BANDS * ROWS
BLOCKS = 64  # blocks that a centre's members are spread over
BLOCK = 1024  # members of a block in the comparison of mixed buckets
BLOCK_HASHES = 1 << 21  # and hashes of their sets: about 16 MB
COLUMNS = 4096
CACHE = WordHashes()

_i, _j = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(4 * BINS, dtype=np.uint64), indexing="ij")
DRAWS = (mix(_i * GOLDEN + mix(_j + np.uint64(1))) % np.uint64(BINS)).astype(np.int64)  # bins that an empty one tries


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Ascending distinct hashes of the lower-cased word shingles."""
    return np.unique(shingles(CACHE.of(text.lower().split()), n)) if text else np.zeros(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    """One-permutation signature of a non-empty set, with empty bins filled by optimal densification."""
    bins = ((found >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    out[bins[::-1]] = found[::-1]  # the smallest of each bin is written last
    full[bins] = True
    empty = np.nonzero(~full)[0]
    source = np.full(BINS, bins[0])
    for j in range(DRAWS.shape[1]):
        if not len(empty):
            break
        drawn = DRAWS[empty, j]
        met = full[drawn]
        source[empty[met]] = drawn[met]
        empty = empty[~met]
    return np.where(full, out, out[source])


def band_keys(found: np.ndarray) -> np.ndarray:
    rows = signature(found).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * GOLDEN + rows[:, k])
    return key.view(np.int64)


def _sketch(n: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, n) for t in binary(part.column("text"))]
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        part.column("text_key"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "n_shingles", "set_key", "bands"],
                )

    return sketch


def _confirm(n: int, percent: int):
    """Rows arrive sorted by (centre, block) with the centre's text first; one set is held at a time."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch):
                a, b = [], []
                centres, nodes = part.column("centre").to_pylist(), part.column("node").to_pylist()
                for centre, node, text in zip(centres, nodes, binary(part.column("text")), strict=True):
                    found = shingle_set(text, n)
                    if node == centre:
                        held, own = centre, found
                    elif held == centre:
                        both = len(np.intersect1d(own, found, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(found) - both):
                            a.append(centre)
                            b.append(node)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return confirm


def confirmed(texts: DataFrame, candidates: DataFrame, n: int, percent: int) -> DataFrame:
    """The candidates (centre, node) whose full shingle sets, from (node, text), are similar enough."""
    block = F.pmod(F.xxhash64("node"), F.lit(BLOCKS))
    members = candidates.select("centre", "node", block.alias("block"))
    centres = members.select("centre", F.col("centre").alias("node"), "block").distinct()
    wanted = members.unionAll(centres)
    sent = wanted.join(texts, "node").repartition("centre", "block")
    sent = sent.sortWithinPartitions("centre", "block", (F.col("node") != F.col("centre")), "node")
    return sent.select("centre", "node", "text").mapInArrow(_confirm(n, percent), "a long, b long").distinct()


def _whole_sets(n: int):
    """Sets as ascending 64-bit hashes."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(text, n).tobytes() for text in binary(part.column("text"))]
                yield pa.record_batch([part.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])

    return whole


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set of ascending distinct values."""
    out = np.zeros((len(left), len(right)), np.float32)
    mine, theirs = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(mine, theirs)
    sides = []
    for sets, values in ((left, mine), (right, theirs)):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, values)
        use = common[np.minimum(at, len(common) - 1)] == values if len(common) else np.zeros(len(values), bool)
        at, owner = at[use], owner[use]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], owner[order]))
    for start in range(0, len(common), COLUMNS):
        dense = []
        for (at, owner), n in zip(sides, out.shape, strict=True):
            lo, hi = np.searchsorted(at, [start, start + COLUMNS])
            block = np.zeros((n, COLUMNS), np.float32)
            block[owner[lo:hi], at[lo:hi] - start] = 1
            dense.append(block)
        out += dense[0] @ dense[1].T
    return out


def _compare(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes, parts = table.column("node").to_numpy(), table.column("component_id").to_numpy()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        left, right = (np.nonzero(side == k.as_py())[0] for k in key[1:])
        out, parent = [], {p: p for p in parts.tolist()}

        def root(p):
            while parent[p] != p:
                parent[p] = parent[parent[p]]
                p = parent[p]
            return p

        if len(left) and len(right):
            both = _shared([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
            close = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
            close &= parts[left][:, None] != parts[right][None, :]
            for i, j in zip(*np.nonzero(close), strict=True):
                a, b = root(int(parts[left[i]])), root(int(parts[right[j]]))
                if a != b:  # a pair whose components are tied by an earlier link of this group adds nothing
                    out.append((int(nodes[left[i]]), int(nodes[right[j]])))
                    parent[a] = b
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], schema=schema)

    return compare


def meetings(buckets: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Rows (key, lo, hi, node, component_id, side) of the groups in which hidden links may be; None if there is none.

    ``buckets`` has (key, centre, node, n_shingles), ``labels`` the component of every linked node. Sides from 0 are
    blocks of the other members, negative ones of the bucket's largest component. Each group holds the two blocks lo
    and hi: an others' block with itself, with each other one and with each block of the largest component.
    """
    named = buckets.where("node > centre").join(labels, "node", "left")
    named = named.withColumn("component_id", F.coalesce("component_id", "node"))
    shares = named.groupBy("key", "component_id").agg(
        F.count("*").alias("members"),
        F.sum("n_shingles").alias("hashes"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same_a"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("same_b"),
    )
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("hashes") / BLOCK_HASHES))
    mixed = shares.groupBy("key").agg(
        F.min("component_id").alias("first"),
        F.max("component_id").alias("last"),
        F.max(F.struct("members", "hashes", "component_id")).alias("main"),
        F.sum("members").alias("members"),
        F.sum("hashes").alias("hashes"),
        F.sum("same_a").alias("same_a"),
        F.bit_xor("same_b").alias("same_b"),
    )
    mixed = mixed.where("first < last").groupBy("members", "same_a", "same_b").agg(
        F.min("key").alias("key"), F.first("hashes").alias("hashes"), F.first("main").alias("main")
    )
    mixed = mixed.select(
        "key",
        F.col("main.component_id").alias("main"),
        F.greatest(F.ceil(F.col("main.members") / BLOCK), F.ceil(F.col("main.hashes") / BLOCK_HASHES)).alias("mains"),
        (F.col("members") - F.col("main.members")).alias("members"),
        (F.col("hashes") - F.col("main.hashes")).alias("hashes"),
    ).select("key", "main", "mains", blocks.alias("others"))
    left = stage(named.join(mixed, "key").select("key", "node", "component_id", "main", "mains", "others"))
    if left.isEmpty():
        return None
    apart = F.xxhash64("node", F.lit(2))
    inside = F.col("component_id") == F.col("main")
    left = left.withColumn("side", F.when(inside, -1 - F.pmod(apart, "mains")).otherwise(F.pmod(apart, "others")))
    everyone = F.sequence(-F.col("mains"), F.col("others") - 1)
    others = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    rows = left.withColumn("other", F.explode(F.when(inside, others).otherwise(everyone)))
    return rows.select(
        "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "node", "component_id", "side"
    )


def hidden_links(texts: DataFrame, met: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that tie all components of a group of ``meetings`` which have similar members."""
    wanted = texts.join(met.select("node").distinct(), "node", "left_semi")
    sets = wanted.mapInArrow(_whole_sets(n), "node long, hashes binary")
    rows = met.join(sets, "node").select("key", "lo", "hi", "node", "component_id", "side", "hashes")
    return rows.groupBy("key", "lo", "hi").applyInArrow(_compare(percent), "a long, b long").distinct()


def shared_ids(known: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Edges (a, b) between the classes of one doc_id, None if no doc_id has several."""
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo < hi")
    several = stage(several.select("doc_id"))
    if several.isEmpty():
        return None
    named = known.join(several, "doc_id").select("doc_id", "set_key").distinct().join(classes.select("set_key", "node"), "set_key")
    named = stage(named.select("doc_id", "node"))
    first = named.groupBy("doc_id").agg(F.min("node").alias("a"))
    return named.join(first, "doc_id").where("a < node").select("a", F.col("node").alias("b"))


def near_duplicates(docs: DataFrame, n: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of (doc_id, text).

    Linked are documents whose sets of ``n``-word shingles (lower-cased A-Z; all words as one where there are fewer) have
    100 * intersection >= ``percent`` * union. Null, empty and blank texts have an empty set and are linked with nothing.
    component_id is the smallest doc_id reachable; kept is doc_id = component_id. Repeated rows (same doc_id and text)
    stay as rows with equal results; where rows share a doc_id but not the text, links of either count for both. A row
    without a doc_id is linked with nothing, has no component and is kept. Extra columns are ignored; an empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>"
    sketches = stage(docs.mapInArrow(_sketch(n), schema))
    known = sketches.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    classes = classes.select("set_key", F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("text_key"), "bands", "n_shingles")
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()))

    all_buckets = classes.select(F.explode("bands").alias("key"), "node", "n_shingles")
    shared = all_buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    buckets = stage(all_buckets.join(shared.select("key", "centre"), "key"))
    tried = stage(buckets.where("node > centre").select("centre", "node").distinct())
    # Sorted and merged whatever the size: the members are a share of the documents and grow with them.
    nodes = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "text_key")
    # Rows that repeat a representative's doc_id and text come once.
    texts = docs.join(nodes.hint("merge"), ["doc_id", "text_key"]).groupBy("node").agg(F.min("text").alias("text"))
    texts = stage(texts)
    links = stage(confirmed(texts, tried, n, percent))
    ties = shared_ids(known, classes)
    if ties is not None:
        links = links.unionAll(ties)
    labels = components(links)

    met = meetings(buckets, labels)
    if met is not None:
        more = stage(hidden_links(texts, met, n, percent))
        if not more.isEmpty():
            labels = components(links.unionAll(more))

    least = labels.join(classes.select("node", "rep"), "node").groupBy("component_id").agg(F.min("rep").alias("least"))
    labels = labels.join(least, "component_id").select("node", "least")
    named = classes.select("set_key", "node", "rep").join(labels, "node", "left")
    named = named.select("set_key", F.coalesce("least", "rep").alias("component_id"))
    found = sketches.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of (doc_id, text, ...) that stay: of each component its smallest doc_id, once; all columns unchanged.

    Rows without a doc_id stay. Of rows that share a doc_id one stays: that of the smallest text (null first) and, for equal
    texts, of the smallest hash of its columns.
    """
    found = stage(near_duplicates(docs, n, percent).where("doc_id IS NOT NULL"))
    gone = found.where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti")  # grows with the documents: never broadcast
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    hashed = [F.col(f"`{f.name}`") for f in left.schema if "map<" not in f.dataType.simpleString()]
    every = [F.col(f"`{c}`") for c in left.columns]
    named = left.where("doc_id IS NOT NULL").groupBy("doc_id")
    named = named.agg(F.min_by(F.struct(*every), F.struct("text", F.xxhash64(*hashed).alias("rest"))).alias("row")).select("row.*")
    return named.unionByName(left.where("doc_id IS NULL"))
