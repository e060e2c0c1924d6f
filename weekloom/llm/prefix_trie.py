"""Prefix trie of conversations from padded turn-id matrices.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it.

1. Each turn becomes a 128-bit id, and its number of words. Turns are numbered by a running total over range-partitioned
   rows, so a conversation that holds a third of all turns is not put into one window.
2. A conversation is cut into segments of ``WIDTH`` turns. A segment carries a key of all turns before it, so segments
   behind the same node have the same key, and no matrix is wider than ``WIDTH``.
3. Segments are range-partitioned by (key, turn ids, conv_id) into shards of bounded size. A shard ranks its ids, pads
   them to a matrix, and sorts it by ``numpy.lexsort``. Change masks of the columns, OR-accumulated from the left, mark
   where the nodes of each depth start; ``reduceat`` adds up every depth.
4. All figures are sums over members: a child counts at the row that starts it, a leaf at its first row, and a row that
   does not start its node saves that turn's words. So parts of a node that a shard's border cuts simply add up: only
   nodes at a border, or with members of several segments, are recombined by key. Later segments add their sums to the
   nodes of the earlier ones along the conversation.
5. The list of members that end in a node is hashed where it lies. Where borders cut it, its pieces are hashed in order
   by one stream that holds one piece at a time.

Memory of a task: one shard (at most about ``SHARD_ROWS`` segments). The driver sees three rows a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.words import binary, slices
from weekloom.operators.lookup import running_total
from weekloom.session import fix, stage

WIDTH = 64
SHARD_ROWS = 32_768
PIECE_IDS = 50_000  # conv_ids of one piece of a cut list
NOTHING = hashlib.sha256(b"").hexdigest()
BIG = np.iinfo(np.int64).max


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, id (128 bits of role and text), words of every row that has a conv_id; null role or text: empty."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, words = [], []
                for role, text in zip(binary(part.column("role")), binary(part.column("text")), strict=True):
                    role, text = role or b"", text or b""
                    found.append(xxhash.xxh3_128_digest(len(role).to_bytes(8, "big") + role + text))
                    words.append(len(text.split()))
                yield pa.record_batch(
                    [part.column("conv_id"), part.column("turn"), pa.array(found, pa.binary()), pa.array(words, pa.int64())],
                    ["conv_id", "turn", "id", "words"],
                )

    own = conversations.select(
        *(F.col(c).cast(kind).alias(c) for c, kind in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")))
    )
    return own.where("conv_id IS NOT NULL").mapInArrow(ids, "conv_id long, turn long, id binary, words long")


def numbered(turns: DataFrame) -> DataFrame:
    """Adds pos (from 0, by turn with null first, then id) and n_turns of the conversation."""
    return running_total(turns, ["conv_id"], ["turn", "id"], F.lit(1).cast("long"), "pos", "n_turns")


def as_told(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "pos", "id", "words")


def forked(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % every, h = crc32(c) % heads.

    The base gives its first h turns (all if it has fewer, none if there is no such conversation); the conversation's
    own turns follow, without its own first h. One without any turn left is a row without pos, id and words.
    """
    conv = F.col("conv_id")
    turns = stage(
        turns.withColumn("base", conv - conv % every).withColumn("h", F.crc32(conv.cast("string").cast("binary")) % heads)
    )
    first = turns.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < heads - 1))
    head = F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("head")
    joined = turns.join(first.groupBy("base").agg(head), "base", "left")
    given = F.least(F.col("h"), F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    joined = joined.withColumn("given", F.when(F.col("head").isNull(), F.lit(0)).otherwise(given).cast("long"))
    own = joined.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "id", "words")
    one = joined.where("pos = 0")  # one row of each conversation
    taken = one.where("given > 0").select("conv_id", F.explode(F.slice("head", 1, F.col("given").cast("int"))).alias("t"))
    bare = one.where("given = 0 AND n_turns <= h").selectExpr(
        "conv_id", "cast(NULL AS long) AS pos", "cast(NULL AS binary) AS id", "cast(NULL AS long) AS words"
    )
    return own.unionAll(taken.select("conv_id", "t.pos", "t.id", "t.words")).unionAll(bare)


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, seg, key, next, ids, words, more: runs of ``WIDTH`` turns with a key of all turns before and up to the end."""
    mark = F.xxhash64("pos", "id").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(11,0)")
    mark = (mark + F.pmod(F.xxhash64("id", "pos", F.lit(7)), F.lit(1 << 32)).cast("decimal(11,0)")).cast("decimal(38,0)")
    turn = F.when(F.col("id").isNotNull(), F.struct("pos", "id", "words"))
    own = (
        turns.withColumn("mark", F.when(F.col("id").isNotNull(), mark).otherwise(F.lit(0)))
        .withColumn("seg", F.expr(f"coalesce(pos, 0) div {WIDTH}"))
        .groupBy("conv_id", "seg")
        .agg(F.sort_array(F.collect_list(turn)).alias("t"), F.sum("mark").cast("decimal(38,0)").alias("mark"))
    )
    own = stage(own.select("conv_id", "seg", F.col("t.id").alias("ids"), F.col("t.words").alias("words"), "mark"))
    full = own.where((F.col("seg") > 0) | (F.size("ids") == WIDTH)).select("conv_id", "seg", "mark")
    last = own.where("seg > 0").groupBy("conv_id").agg(F.max("seg").alias("last"))
    summed = running_total(full, ["conv_id"], ["seg"], F.col("mark"), "key", "all").select("conv_id", "seg", "key")
    rest = own.join(summed, ["conv_id", "seg"], "left").join(last, "conv_id", "left")
    key = F.coalesce(F.col("key").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return rest.select(
        "conv_id",
        "seg",
        key.cast("string").alias("key"),
        (key + F.col("mark")).cast("decimal(38,0)").cast("string").alias("next"),
        "ids",
        "words",
        (F.col("seg") < F.coalesce("last", F.lit(0))).alias("more"),
    )


SEGMENT = "conv_id long, seg long, key string, next string, ids array<binary>, words array<long>, more boolean"


def _ranks(ids: np.ndarray) -> np.ndarray:
    """Dense ranks of (n, 2) ids, in their byte order."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]).any(axis=1)
    out = np.empty(len(ids), np.int32)
    out[order] = np.cumsum(new) - 1
    return out


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The turn ids of the rows as a matrix of ranks, padded with -1, and the number of turns of each row."""
    lists = table.column("ids").combine_chunks()
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    raw = np.frombuffer(b"".join(lists.flatten().to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
    out = np.full((len(size), int(size.max(initial=0))), -1, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = _ranks(raw)
    return out, size


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    batches = list(batches)
    table = pa.Table.from_batches(batches) if batches else None
    return table if table is not None and table.num_rows else None


def _sorted_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shard's rows in order, each with ``same``: the leading turns it shares with the row before, -1: another key."""
    table = _whole(batches)
    if table is None:
        return
    m, _ = matrix(table)
    key = np.array([f"{s:020d}{k}" for s, k in zip(table.column("seg").to_pylist(), table.column("key").to_pylist(), strict=True)])
    key = np.unique(key, return_inverse=True)[1]
    conv, more = table.column("conv_id").to_numpy(), table.column("more").to_numpy(zero_copy_only=False)
    order = np.lexsort((conv, more, *m.T[::-1], key))
    m, key = m[order], key[order]
    changed = np.ones((len(m), m.shape[1] + 1), bool)
    changed[1:, 0] = key[1:] != key[:-1]
    changed[1:, 1:] = m[1:] != m[:-1]
    np.logical_or.accumulate(changed, axis=1, out=changed)
    size = (m >= 0).sum(axis=1)
    same = np.minimum((~changed).sum(axis=1) - 1, size)
    same[1:] = np.minimum(same[1:], size[:-1])
    yield from table.take(pa.array(order)).append_column("same", pa.array(same, pa.int64())).combine_chunks().to_batches(4096)


EDGE = "shard int, place int, seg long, key string, ids array<binary>, more boolean"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First row of the shard, the first one that differs from it in more than conv_id, and the last row."""
    out, first, last, met = [], None, None, False
    for batch in batches:
        for row in batch.select(["shard", "seg", "key", "ids", "more"]).to_pylist():
            place = dict(row)
            if first is None:
                first = place
                out.append({"place": 0, **place})
            elif not met and place != first:
                met = True
                out.append({"place": 1, **place})
            last = place
    if last is not None:
        out.append({"place": 2, **last})
    schema = [("shard", pa.int32()), ("place", pa.int32()), ("seg", pa.int64()), ("key", pa.string()), ("ids", pa.list_(pa.binary())), ("more", pa.bool_())]
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(schema))


def _neighbours(edges: list) -> dict[int, tuple]:
    """For each shard: the row before it, the row after it, and the first later row that differs from its last one."""
    row = lambda e: (e["seg"], e["key"], tuple(bytes(x) for x in e["ids"]), e["more"])
    shards: dict[int, dict[int, tuple]] = {}
    for e in edges:
        shards.setdefault(e["shard"], {})[e["place"]] = row(e)
    names = sorted(shards)
    out = {}
    later = None  # the first row after the shard at hand, and the first one after it that differs
    after: tuple | None = None
    for name in reversed(names):
        own = shards[name]
        differs = after if after is not None and after != own[2] else later
        out[name] = [None, after, differs]
        # as seen from the shard before: its next row is own[0]; beyond equal rows comes own[1] or what follows this shard
        later = own.get(1) if 1 in own else differs
        after = own[0]
    for a, b in zip(names, names[1:], strict=False):
        out[b][0] = shards[a][2]
    return {k: tuple(v) for k, v in out.items()}


def _shared(a: tuple | None, b: tuple | None) -> int:
    """Leading turns that two rows share; -1 if they have different keys."""
    if a is None or b is None or a[:2] != b[:2]:
        return -1
    n = 0
    for x, y in zip(a[2], b[2], strict=False):
        if x != y:
            break
        n += 1
    return n


NODE = (
    "depth long, node binary, parent binary, open boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends string, at long, piece binary, seg long, leaf long"
)
FIELDS = [x.split() for x in NODE.split(", ")]
ARROW = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
NODE_SCHEMA = pa.schema([(name, ARROW[kind]) for name, kind in FIELDS])


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns.get(f.name, [None] * n), f.type) for f in NODE_SCHEMA], schema=NODE_SCHEMA)


def node_key(key: str, ids: list[bytes], j: int, after: str) -> bytes:
    """The key of the node behind the first j turns of a segment; alike from both sides of a segment's end."""
    if j == 0 or j == WIDTH:
        return xxhash.xxh3_128_digest(b"k" + (after if j else key).encode())
    return xxhash.xxh3_128_digest(b"n" + key.encode() + b"|" + b"".join(ids[:j]))


def _joined_ids(conv: np.ndarray) -> bytes:
    return ",".join(map(str, conv.tolist())).encode()


def _shard_nodes(neighbours: dict[int, tuple]):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        before, after, differs = neighbours[table.column("shard")[0].as_py()]
        lists, keys, nexts = (table.column(c).to_pylist() for c in ("ids", "key", "next"))
        segs, conv = table.column("seg").to_numpy(), table.column("conv_id").to_numpy()
        more, same = table.column("more").to_numpy(zero_copy_only=False), table.column("same").to_numpy().copy()
        n = len(conv)
        size = np.array([len(x) for x in lists])
        whole = lambda r: (segs[r].item(), keys[r], tuple(lists[r]), bool(more[r]))
        same[0] = _shared(before, whole(0))
        follows = _shared(whole(n - 1), after)

        # Words of turn 1..j of each row, and what a row saves from depth j on.
        width = int(size.max())
        words = np.zeros((n, width + 1), np.int64)
        listed = table.column("words").combine_chunks()
        words[:, 1:][np.arange(width) < size[:, None]] = listed.flatten().to_numpy()
        total = np.cumsum(words, axis=1)
        saved = total[np.arange(n), np.maximum(same, 0)]  # same <= size

        # A run of rows that end in one node: is the next other row one that goes on from there?
        equal = np.zeros(n, bool)
        equal[1:] = (same[1:] == size[1:]) & (size[1:] == size[:-1]) & (more[1:] == more[:-1])
        run = np.nonzero(~equal)[0]
        goes_on = np.empty(len(run), bool)
        goes_on[:-1] = same[run[1:]] >= size[run[:-1]]
        goes_on[-1] = _shared(whole(n - 1), differs) >= size[n - 1]
        leaf = np.zeros(n, bool)
        leaf[run] = ~more[run] & (same[run] < size[run]) & ~goes_on
        if before is not None and before == whole(0):
            leaf[0] = False

        bound = np.append(run, n)
        cut_first, cut_last = before is not None and before == whole(0), after is not None and after == whole(n - 1)
        for r, stop in zip(run, bound[1:], strict=True):  # lists that a border cuts go out in pieces
            if not more[r] and ((r == 0 and cut_first) or (stop == n and cut_last)):
                name = node_key(keys[r], lists[r], size[r], nexts[r])
                for at in range(r, stop, PIECE_IDS):
                    part = conv[at : min(stop, at + PIECE_IDS)]
                    yield _rows(node=[name], at=[int(part[0])], piece=[_joined_ids(part)])
        late = np.nonzero(segs > 0)[0]
        if len(late):
            yield _rows(at=conv[late], seg=segs[late], saved_tokens=saved[late], leaf=leaf[late].astype(np.int64))

        held = same < 0  # row starts a new key; the first row of a shard starts its groups here
        parents, parent_starts = None, None
        for j in range(width + 1):
            begins = (same < j) if j else held.copy()
            begins[0] = True
            starts = np.nonzero(begins)[0]
            stops = np.append(starts[1:], n)
            least = np.minimum.reduceat(conv, starts)
            sums = {
                "n_convs": stops - starts,
                "n_children": np.add.reduceat(((size > j) & (same < j + 1)).astype(np.int64), starts),
                "n_leaves": np.add.reduceat(leaf.astype(np.int64), starts),
                "saved_tokens": np.add.reduceat(np.maximum(saved - total[:, max(j - 1, 0)], 0), starts),
            }
            several = np.add.reduceat(more.astype(np.int64), starts) > 0
            open_ = several.copy()
            open_[0] |= same[0] >= j
            open_[-1] |= follows >= j
            real = size[starts] >= j
            if j == 0:
                inner = segs[starts] > 0  # the node belongs to the segment before, here are only its children
                open_ |= inner
                least = np.where(inner, BIG, least)
                for name in ("n_convs", "n_leaves", "saved_tokens"):
                    sums[name] = np.where(inner, 0, sums[name])
            at = np.nonzero(real)[0]
            ends, names, above, over = [], [], [], []
            for g in at:
                r = starts[g]
                names.append(node_key(keys[r], lists[r], j, nexts[r]))
                above.append(node_key(keys[r], lists[r], j - 1, nexts[r]) if j else None)
                over.append(None)
                if j:
                    least_above, open_above = parents
                    own = int(np.searchsorted(parent_starts, r, side="right")) - 1
                    over[-1] = None if open_above[own] else int(least_above[own])
                ends.append(None)
                if size[r] == j and not more[r]:
                    i = int(np.searchsorted(bound, r, side="right"))
                    if not ((r == 0 and cut_first) or (bound[i] == n and cut_last)):
                        ends[-1] = hashlib.sha256(_joined_ids(conv[r : bound[i]])).hexdigest()
            if len(at):
                yield _rows(
                    depth=segs[starts[at]] * WIDTH + j,
                    node=names,
                    parent=above,
                    open=open_[at],
                    conv_id=least[at],
                    parent_conv_id=over,
                    ends=ends,
                    **{k: v[at] for k, v in sums.items()},
                )
            parents, parent_starts = (least, open_), starts

    return nodes


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What later segments of a conversation add to the nodes of an earlier one."""
    for batch in batches:
        for part in slices(batch, "key", 1 << 16):
            names, saved, leaves = [], [], []
            for row in part.to_pylist():
                for j in range(min(1, row["seg"]), WIDTH + 1):
                    names.append(node_key(row["key"], row["ids"], j, row["next"]))
                    saved.append(row["add_saved"])
                    leaves.append(row["add_leaf"])
            yield _rows(node=names, saved_tokens=saved, n_leaves=leaves, n_convs=[0] * len(names), n_children=[0] * len(names))


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, at): the hash of each node's pieces, joined by commas; one piece is held at a time."""
    name, digest = None, None
    schema = pa.schema([("node", pa.binary()), ("pieces", pa.string())])
    for batch in batches:
        done = []
        for node, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if node != name:
                if name is not None:
                    done.append({"node": name, "pieces": digest.hexdigest()})
                name, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece)
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if name is not None:
        yield pa.RecordBatch.from_pylist([{"node": name, "pieces": digest.hexdigest()}], schema=schema)


def nodes(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, pos, id, words), pos from 0 without gaps; see ``prefix_trie``."""
    spark = turns.sparkSession
    parts = stage(segments(turns))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // SHARD_ROWS))
    order = ["seg", "key", "ids", "more", "conv_id"]
    dealt = parts.repartitionByRange(shards, *order).mapInArrow(_sorted_shard, f"{SEGMENT}, same long")
    dealt = fix(dealt.withColumn("shard", F.spark_partition_id()))
    # Three rows a shard, of at most WIDTH turn ids each.
    neighbours = _neighbours(dealt.mapInArrow(_edges, EDGE).collect())
    found = stage(dealt.mapInArrow(_shard_nodes(neighbours), NODE))

    late = found.where("seg IS NOT NULL").select(F.col("at").alias("conv_id"), "seg", "saved_tokens", "leaf")
    whole = found.where("depth IS NOT NULL")
    columns = ["node", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    parted = whole.where("open").select(*columns, "depth", "parent", "conv_id", "parent_conv_id", "ends")
    if not late.isEmpty():
        # One sum for both: a conversation has at most one leaf, at its end.
        summed = running_total(late, ["conv_id"], ["seg"], F.col("saved_tokens") * 2 + F.col("leaf"), "earlier", "all")
        summed = summed.selectExpr(
            "conv_id", "seg - 1 AS seg", "(`all` - earlier) div 2 AS add_saved", "pmod(`all`, 2) AS add_leaf"
        )
        added = dealt.where("more").select("conv_id", "seg", "key", "next", "ids").join(summed, ["conv_id", "seg"])
        added = added.mapInArrow(_later, NODE).select(*columns, *(F.lit(None).cast(k).alias(c) for c, k in (("depth", "long"), ("parent", "binary"), ("conv_id", "long"), ("parent_conv_id", "long"), ("ends", "string"))))
        parted = parted.unionAll(added)
    sums = [F.sum(c).alias(c) for c in columns[1:]]
    parted = parted.groupBy("node").agg(
        *sums, *(F.max(c).alias(c) for c in ("depth", "parent", "parent_conv_id", "ends")), F.min("conv_id").alias("conv_id")
    )
    pieces = found.where("piece IS NOT NULL").select("node", "at", "piece").repartition("node").sortWithinPartitions("node", "at")
    hashed = pieces.select("node", "piece").mapInArrow(_hash_pieces, "node binary, pieces string")
    parted = stage(parted.join(hashed, "node", "left").withColumn("ends", F.coalesce("pieces", "ends")).drop("pieces"))

    out = ["conv_id", "depth", "parent_conv_id", *columns[1:], "ends"]
    every = whole.where("NOT open").select("parent", *out).unionAll(parted.select("parent", *out))
    known = every.where("parent_conv_id IS NOT NULL OR depth = 0").select(*out)
    asked = every.where("parent_conv_id IS NULL AND depth > 0").drop("parent_conv_id")
    asked = asked.join(parted.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    final = known.unionAll(asked.select(*out))
    return final.select(*out[:-1], F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, rebuild: Callable[[DataFrame], DataFrame] = as_told) -> DataFrame:
    """A row for each node of the trie of (conv_id, turn, role, text); ``rebuild`` changes the numbered turns before.

    conv_id: the node's smallest member; depth: its number of turns, 0 for the root; parent_conv_id: that of its parent,
    null for the root; n_convs: members; n_children; n_leaves: childless nodes in its subtree; saved_tokens: over its
    subtree, (members - 1) times the words of the node's last text; ends_sha256: of the members that end here, ascending,
    joined by commas.

    Turns are ordered by number, null first; equal numbers by a hash of role and text, so that the result does not depend
    on the order of rows; repeated rows are repeated turns. Null role or text is empty. Rows without a conv_id are left
    out. Extra columns are ignored; an empty table gives no rows, not even a root.
    """
    return nodes(rebuild(numbered(turn_ids(conversations))))
