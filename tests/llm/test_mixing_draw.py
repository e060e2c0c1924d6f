"""The draw and the cut of the mix against a plain loop, columns of any name, and rows that tie."""

import math

import numpy as np
from pyspark.sql import functions as F

from weekloom.llm import mixing

DATA = "/root/testdata/sf0.001"


def drawn_by_hand(rows, target):
    """Copies of the rows (key, size) of one source: whole ones, then the smallest ranks up to the target, then a filler."""
    source_size, roots = sum(s for _, s in rows), sum(math.sqrt(s) for _, s in rows)
    ratio = target / source_size if source_size else 0.0
    base = math.floor(ratio + 1e-12)
    share, copies, ranked = max(ratio - base, 0.0), {}, []
    for key, size in rows:
        copies[key] = base
        if size and share > 1e-9:
            chance = min(max(share * source_size / roots / math.sqrt(size), 1e-9), 1 - 1e-9)
            u = ((key % (1 << 52)) + 0.5) / float(1 << 52)
            q = u / (1 - u) * (1 - chance) / chance
            ranked.append((q / (1 + q), key, size))
    ranked.sort()
    wanted, taken, k = target - base * source_size, 0, 0
    while k < len(ranked) and taken + ranked[k][2] <= wanted:
        taken += ranked[k][2]
        copies[ranked[k][1]] += 1
        k += 1
    gap = wanted - taken
    fitting = [(abs(size - gap), rank, key) for rank, key, size in ranked[k:] if abs(size - gap) < gap]
    if fitting:
        copies[min(fitting)[2]] += 1
    return copies


def test_draw_and_cut_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mixed(docs).withColumn("n", F.xxhash64("doc_id", "text", F.lit("mix"))).toPandas()
    assert len(got) == docs.count()
    for _, rows in got.groupby("source", dropna=False):
        want = drawn_by_hand(list(zip(rows.n.tolist(), rows["size"].tolist(), strict=True)), rows.target.iloc[0])
        assert dict(zip(rows.n, rows.copies, strict=True)) == want


def test_columns_with_the_names_of_working_columns_stay(spark):
    names = [*mixing.WORKING, "Rank2", "a.b"]
    values = [f"v{i}" for i in range(len(names))]
    schema = ", ".join(["doc_id long", "text string", "source string", *(f"`{c}` string" for c in names), "size string"])
    rows = [(i, "some words here " * (i % 5), "s" if i % 3 else None, *values, "old") for i in range(40)]
    got = mixing.mixed(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "source", *names, *mixing.MADE]
    found = got.collect()
    assert len(found) == 40 and all(list(r[3 : 3 + len(names)]) == values for r in found)
    assert {r.doc_id: r.size for r in found} == {i: 3 * (i % 5) for i in range(40)}


def test_repeated_rows_are_taken_together(spark):
    rows = [(i, "one two three", s) for i in range(30) for s in ("a", "b") for _ in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mixed(frame).toPandas()
    assert len(first) == 180 and (first.groupby(["doc_id", "source"]).copies.nunique() == 1).all()
    again = mixing.mixed(frame.repartition(5)).toPandas()
    key = ["source", "doc_id"]
    assert first.sort_values(key).copies.tolist() == again.sort_values(key).copies.tolist()
    by = first.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 9).all() and first.copies.max() <= mixing.MOST
