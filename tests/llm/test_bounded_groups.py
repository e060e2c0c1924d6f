"""No group of the substring search and no pass of the decontamination grows with one key or one table."""

import pickle
from collections import Counter

from test_llm import PASSAGE

from weekloom.llm import decontaminate, substring
from weekloom.session import workers_find_package


def test_rows_without_a_doc_id_spread_over_batches(spark):
    workers_find_package(spark)
    rows = spark.range(20_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "concat('text number ', id) AS text")
    repeated = rows.selectExpr("1L AS doc_id", "text")
    for frame in (rows, repeated):
        dealt, _, _ = substring._answered(frame, 50, 256)
        sizes = [r["count"] for r in dealt.count().collect()]
        assert len(sizes) > 60 and max(sizes) < 3 * 256


def test_buckets_follow_the_documents(spark, monkeypatch):
    frame = spark.range(100).selectExpr("id AS doc_id", f"concat(id, ' {PASSAGE}') AS text")
    want = Counter(map(tuple, substring.repeated_spans(frame).drop("spans").collect()))
    monkeypatch.setattr(substring, "BUCKET_DOCS", 2)
    assert substring._answered(frame, 50, 256)[2] == 50
    assert Counter(map(tuple, substring.repeated_spans(frame, batch_docs=7).drop("spans").collect())) == want
    assert sum(n * k[2] for k, n in want.items()) == 99 * 60


def test_one_pass_at_a_time(spark, monkeypatch):
    """The items of a pass are read after those of the pass before were used, and the sent index holds no filter."""
    workers_find_package(spark)
    items = spark.range(40).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(1, 30), x -> concat('i', id, 'w', x))) AS text")
    docs = items.selectExpr("item_id AS doc_id", "concat('before ', text, ' after') AS text").where("doc_id % 3 > 0")
    docs = docs.unionAll(spark.range(100, 110).selectExpr("id", "concat('clean ', id)"))
    seen, made = [], decontaminate.Index

    def watched(rows, contained):
        index = made(rows, contained)
        seen.append(len(index.ids))
        return index

    monkeypatch.setattr(decontaminate, "Index", watched)
    whole = decontaminate.contamination(docs, items).collect()
    assert seen == [40]
    seen.clear()
    passes, found = decontaminate.indexes(items, 0.8, 500)
    assert passes > 5 and not seen
    index = next(found)
    assert len(seen) == 1 and seen[0] < 40
    assert all(p.filter.any() for p in index.partitions) and len(pickle.dumps(index.partitions)) < 100_000
    seen.clear()
    split = decontaminate.contamination(docs, items, pass_bytes=500).collect()
    key = lambda r: (r.doc_id, r.contaminated, r.n_items, tuple(r.item_ids), r.most)
    assert Counter(map(key, split)) == Counter(map(key, whole)) and sum(r.contaminated for r in split) == 26
    assert len(seen) == passes and sum(seen) == 40
    assert sorted(r.doc_id for r in decontaminate.cleaned(docs, items, pass_bytes=500).collect()) == list(range(100, 110))


def test_items_of_few_words_are_never_missed(spark):
    """Ten thousand items of five to twelve words, each in a document among other words."""
    workers_find_package(spark)
    words = "concat_ws(' ', transform(sequence(1, 5 + id % 8), x -> concat('q', id, 'w', x)))"
    items = spark.range(10_000).selectExpr("id AS item_id", f"{words} AS text")
    filler = "concat_ws(' ', transform(sequence(1, 40), x -> concat('f', hash(item_id, x) % 1000)))"
    docs = items.selectExpr("item_id AS doc_id", f"concat({filler}, ' ', text, ' ', {filler}) AS text")
    found = decontaminate.contamination(docs, items)
    assert not found.where("NOT contaminated OR item_ids <> array(doc_id)").count()
