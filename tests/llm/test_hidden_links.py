"""Links between members of one bucket that its centre does not show: whole results, and how many rows they take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.llm import minhash


def shingled(text, n=3):
    ws = text.lower().split()
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}


def changed(rng, base, k):
    ws = list(base)
    for i in rng.choice(len(ws), k, replace=False):
        ws[i] = f"z{rng.integers(10**9)}"
    return " ".join(ws)


def parts_of(texts, percent):
    sets = {i: shingled(t) for i, t in texts}
    part = {i: i for i in sets}
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and part[i] != part[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                lo, hi = sorted((part[i], part[j]))
                part = {k: lo if v == hi else v for k, v in part.items()}
    return part


@pytest.fixture()
def emitted(monkeypatch):
    """The number of rows that the comparison of mixed buckets returned."""
    counts, plain = [], minhash.hidden_links

    def counted(*a):
        out = plain(*a)
        counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "hidden_links", counted)
    return counts


def test_long_texts_that_are_alike_but_not_enough_emit_nothing(spark, emitted):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(700)]
    rows = [(i, changed(rng, base, 24)) for i in range(1, 121)]  # about 0.75 to each other
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.component_id for r in got} == set(range(1, 121)) == set(parts_of(rows, 85).values())
    assert sum(emitted) == 0


def test_long_texts_of_several_components_emit_a_forest(spark, emitted):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(700)]
    rows = [(i, changed(rng, base, int(rng.integers(4, 20)))) for i in range(1, 121)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == parts_of(rows, 85)
    assert sum(emitted) <= minhash.BANDS * len(rows)


def test_one_outsider_meets_a_large_component_in_linear_rows(spark):
    members = spark.range(1, 20_001).select(F.explode(F.array(F.lit(7), F.lit(8))).alias("key"), F.lit(0).cast("long").alias("centre"), F.col("id").alias("node"))
    members = members.withColumn("n_shingles", F.lit(100).cast("long"))
    labels = spark.range(1, 20_000).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component_id"))
    met = minhash.meetings(members.withColumn("key", F.col("key").cast("long")), labels)
    blocks = -(-20_000 // minhash.BLOCK)
    assert 20_000 <= met.count() <= 20_000 + 1 + blocks  # the two buckets have the same members: one is enough
    sizes = met.groupBy("key", "lo", "hi").count().agg(F.max("count")).first()[0]
    assert sizes < 1.5 * minhash.BLOCK
    assert met.where("node = 20000").count() == blocks + 1


def test_blocks_are_bounded_by_hashes_and_every_pair_meets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = spark.range(1, 61).selectExpr("5L AS key", "0L AS centre", "id AS node", "IF(id > 30, 2000000L, 10L) AS n_shingles")
    labels = spark.range(1, 61).selectExpr("id AS node", "IF(id <= 20, 1L, id - id % 2) AS component_id")
    met = minhash.meetings(rows, labels).toPandas()
    pairs = set()
    for (_, lo, hi), group in met.groupby(["key", "lo", "hi"]):
        left, right = group[group.side == lo], group[group.side == hi]
        pairs |= {tuple(sorted((x, y))) for x in left.node for y in right.node}
    part = dict(zip(met.node, met.component_id, strict=True))
    assert all((x, y) in pairs for x in part for y in part if x < y and part[x] != part[y])
    alone = {i for i in part if part[i] == 1}
    assert not any(x in alone and y in alone for x, y in pairs)


def test_buckets_of_one_component_or_of_two_members_need_no_meeting(spark):
    rows = spark.createDataFrame([(1, 0, 1, 5), (1, 0, 0, 5), (2, 3, 4, 5), (2, 3, 5, 5), (2, 3, 3, 5)], "key long, centre long, node long, n_shingles long")
    labels = spark.createDataFrame([(4, 3), (5, 3), (3, 3)], "node long, component_id long")
    assert minhash.meetings(rows, labels) is None


def test_intersections(spark):
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in sizes] for sizes in ((5, 8000, 300), (6000, 1)))
    want = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert (minhash._shared(left, right) == want).all()
    assert (minhash._shared([np.array([1], np.uint64)], [np.array([2], np.uint64)]) == 0).all()


def test_one_row_of_a_shared_id_is_chosen_by_its_text(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "ba"]
    rows = [(1, t, k, {"m": 1}) for t in texts for k in (2, 1)] + [(2, "other words here", 0, None), (None, "x", 0, None), (None, "x", 0, None)]
    schema = "doc_id long, text string, row int, `a.b` map<string,int>"
    want = None
    for parts in (1, 5):
        kept = minhash.one_of_each(spark.createDataFrame(rows, schema).repartition(parts))
        assert kept.columns == ["doc_id", "text", "row", "a.b"]
        got = sorted((str(r.doc_id), r.text, r.row) for r in kept.collect())
        want = want or got
        assert got == want and [x[:2] for x in got] == [("1", texts[1]), ("2", "other words here"), ("None", "x"), ("None", "x")]
