"""The prefix trie against a plain trie of tuples."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from weekloom.llm import prefix_trie
from weekloom.session import workers_find_package

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True)
def _package(spark):
    workers_find_package(spark)


def told(rows):
    convs = {}
    for c, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or 0)):
        if c is not None:
            convs.setdefault(c, []).append((role or "", text or ""))
    return convs


def forked(convs, every=20, heads=4):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = convs.get(c - c % every, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {n: 0 for n in members}
    leaves, saved = dict(children), dict(children)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n in members:
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members[n]) - 1) * len(n[-1][1].encode().split()) if n else 0
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
         hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items()
    )


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def conversations(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(0, 90):
        for t in range(int(rng.integers(1, 7))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"turn {t} kind {rng.integers(0, 2)}\tand  more"))
    for c in range(200, 230):  # one hot conversation
        rows += [(c, t, "user", f"same words {t}") for t in range(3)]
    long = [(t, "user", f"step {t} of many") for t in range(200)]
    rows += [(300, *x) for x in long] + [(301, *x) for x in long[:64]] + [(302, *x) for x in long[:128]]
    rows += [(303, *x) for x in long[:130]] + [(304, *x) for x in long[:100]] + [(304, 100, "user", "another way")]
    rows += [(305, *x) for x in long] + [(306, *x) for x in long[:190]] + [(306, t, "user", "x") for t in range(190, 260)]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_trie_equals_a_plain_one(spark, partitions):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert rows_of(prefix_trie.prefix_trie(frame)) == brute(told(rows))
        assert rows_of(prefix_trie.prefix_trie(frame, prefix_trie.forked)) == brute(forked(told(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cut_lists_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = [(c, t, "user", f"a {t}") for c in range(1, 101) for t in range(2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(prefix_trie.prefix_trie(frame)) == brute(told(rows))


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [
        (1, None, "user", "first"), (1, 0, None, "hello there"), (1, 1, "user", None), (2, 0, "", "hello there"),
        (2, 1, "user", ""), (3, 0, None, None), (4, 0, "user", long), (5, 0, "user", long), (None, 0, "user", "lost"),
        (-7, 0, "user", "below zero"), (20, 0, "ab", "c"), (21, 0, "a", "bc"), (22, 0, "x", "y"), (23, 0, "x", "y"),
        (23, 0, "x", "y"), (2**62, 5, "user", "far"),
    ]
    extra = "pos long, id string, words string, node string, depth string, seg string, shard string"
    frame = spark.createDataFrame([(*r, 1, "i", "w", "n", "d", "s", "h") for r in rows], f"{SCHEMA}, {extra}").repartition(2)
    assert rows_of(prefix_trie.prefix_trie(frame)) == brute(told(rows))
    got = prefix_trie.prefix_trie(frame, prefix_trie.forked)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = {c: zlib.crc32(str(c).encode()) % 4 for c in told(rows)}
    base = lambda c: c - int(np.fmod(c, 20))
    convs = {c: told(rows).get(base(c), [])[: want[c]] + own[want[c] :] for c, own in told(rows).items()}
    assert rows_of(got) == brute(convs)


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 0, "user", x) for x in "abcdef"] + [(2, 0, "user", x) for x in "fedcba"]
    one = rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)))
    assert one == rows_of(prefix_trie.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(4)))
    assert len(one) == 7 and {r[3] for r in one} == {2}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(none).count() == 0 and prefix_trie.prefix_trie(none, prefix_trie.forked).count() == 0
