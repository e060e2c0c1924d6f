"""The training-data operators on edge cases, against brute force and on held-out rows."""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from weekloom.llm import decontaminate, html_text, minhash, mixing, quality, substring, token_counts, toxicity, urls, vectors
from weekloom.llm.queries import QUERIES
from weekloom.session import workers_find_package

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"x{i % 977}y{i // 977}" for i in range(30_000))
EDGE = [
    (1, f"start {PASSAGE} end\n\nlast", "en", "a", 1),
    (2, f"other  {PASSAGE}\ttail", "en", "a", 1),
    (2, f"other  {PASSAGE}\ttail", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", "b", 4),
    (None, PASSAGE, "en", "b", 1),
    (6, LONG, "en", None, 1),
    (7, LONG + " more", "en", "c", 1),
    (8, "Two Words", "en", "c", 1),
    (9, "two words", "en", "", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    workers_find_package(spark)
    extra = "key string, node string, batch string, score string, size string, copies string"
    rows = [(*r, "k", "n", "b", "s", "z", "c") for r in EDGE]
    return spark.createDataFrame(rows, f"{DOCS}, {extra}").repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, 4000).astype(np.uint64) * np.uint64(0x1234567890ABCDEF)
    h = substring.window_hashes(w, 5)
    assert len(set(h.tolist())) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})


def test_substring(docs, none):
    rows = [(r[0], words(r[1])) for r in EDGE]
    owner = {}
    for i, ws in rows:
        for k in range(len(ws) - 49):
            key = tuple(ws[k : k + 50])
            owner[key] = min(owner.get(key, math.inf), math.inf if i is None else i)
    want = Counter()
    for i, ws in rows:
        gone = {k + j for k in range(len(ws) - 49) if owner[tuple(ws[k : k + 50])] < (math.inf if i is None else i) for j in range(50)}
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        want[(i, len(ws), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter(tuple(r) for r in substring.repeated_spans(docs, batch_docs=2).drop("spans").collect())
    assert got == want
    assert substring.repeated_spans(none).count() == 0


def test_without_repeats_keeps_the_rest(docs):
    got = substring.without_repeats(docs, batch_docs=3)
    assert got.columns == docs.columns
    texts = {r.doc_id: r for r in got.collect()}
    assert texts[1].text == EDGE[0][1] and texts[1].n_chars == 1
    assert texts[2].text == "other  tail" and texts[2].n_chars == len("other  tail")
    assert texts[None].text == "" and texts[3].text is None and texts[7].text == "more" and texts[6].text == LONG


def brute_links(rows, n, percent):
    sets = {}
    for i, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(n, len(ws))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if k else set()
    part = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * len(sets[i] | sets[j]) and part[i] != part[j]:
                lo, hi = sorted((part[i], part[j]))
                part = {k: lo if v == hi else v for k, v in part.items()}
    return {i: (len(sets[i]), part[i]) for i in sets}


def test_near_duplicates_of_chains(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(120):  # copies with one to three words changed: similar to some, not to others
        ws = list(base)
        for k in rng.choice(80, rng.integers(1, 4), replace=False):
            ws[k] = f"z{rng.integers(1_000_000)}"
        rows.append((1000 - i, " ".join(ws)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect()}
    assert got == brute_links(rows, 3, 85)
    assert len({c for _, c in got.values()}) > 1


def test_near_duplicates_of_edge_cases(docs, none):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i} == brute_links([r[:2] for r in EDGE if r[0]], 3, 85)
    assert got[None].component_id is None and got[None].kept and got[9].component_id == 8 and got[7].component_id == 6
    assert minhash.near_duplicates(docs).count() == len(EDGE) and minhash.near_duplicates(none).count() == 0
    kept = [r.doc_id for r in minhash.one_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, 4, 5, 6, 8, None], key=str)


def test_near_duplicates_of_one_id_with_two_texts(spark):
    texts = [" ".join(f"{c}{i}" for i in range(100)) for c in "pqrs"]
    rows = [(i, t) for i in (1, 20) for t in texts]  # the first id links the copies of all its texts
    rows += [(2 + k, f"{t} changed") for k, t in enumerate(texts)] + [(21, f"{texts[0]} other"), (30, "alone here now")]
    rows += [(40, "one text here"), (41, "one text here"), (41, "another text here"), (42, "another text here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame).collect()}
    part = {i: 1 for i in (1, 20, 2, 3, 4, 5, 21)} | {30: 30} | {i: 40 for i in (40, 41, 42)}
    assert got == {(i, c, i == c) for i, c in part.items()}
    assert sorted(r.doc_id for r in minhash.one_of_each(frame, 3, 85).collect()) == [1, 30, 40]


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame(
        [(1, PASSAGE), (2, "TWO words"), (3, None), (4, ""), (None, PASSAGE), (5, "unseen words stand here now"), (1, PASSAGE)],
        "item_id long, text string",
    )
    for size in (1 << 20, 200):  # one pass, several passes
        got = {r.doc_id: r for r in decontaminate.contamination(docs.dropDuplicates(["doc_id"]), items, pass_bytes=size).collect()}
        assert {i for i, r in got.items() if r.contaminated} == {1, 2, None, 8, 9}
        assert got[1].n_items == 3 and got[1].item_ids == [1, 1] and got[8].item_ids == [2] and got[6].item_ids == []
        assert {r.doc_id for r in decontaminate.cleaned(docs, items, pass_bytes=size).collect()} == {3, 4, 5, 6, 7}
    assert decontaminate.contamination(none, items).count() == 0
    assert not decontaminate.contamination(docs, items.limit(0)).where("contaminated").count()


def test_decontamination_in_passes_judges_every_row_by_its_text(spark):
    items = spark.createDataFrame(
        [(1, PASSAGE), (2, "two words"), (None, PASSAGE), (1, PASSAGE), (3, "unseen words stand here now")], "item_id long, text string"
    )
    rows = [(None, PASSAGE), (None, "clean"), (None, None), (1, PASSAGE), (1, "two words"), (1, "clean"), (2, PASSAGE), (2, PASSAGE)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {PASSAGE: (True, 3, (1, 1), 1.0), "two words": (True, 1, (2,), 1.0)}
    want = Counter((i, *found.get(text, (False, 0, (), 0.0))) for i, text in rows)
    for size in (1 << 20, 200):
        got = decontaminate.contamination(frame, items, pass_bytes=size).collect()
        assert Counter((r.doc_id, r.contaminated, r.n_items, tuple(r.item_ids), r.most) for r in got) == want
        left = decontaminate.cleaned(frame, items, pass_bytes=size).collect()
        assert Counter(map(tuple, left)) == Counter(r for r in rows if r[1] not in found)


def test_partial_items(spark):
    rng = np.random.default_rng(5)
    items = [[f"a{i}b{rng.integers(50)}" for _ in range(int(rng.integers(6, 90)))] for i in range(40)]
    rows, want = [], set()
    for d in range(120):
        k = int(rng.integers(40))
        own = list(items[k])
        for at in rng.choice(len(own), int(rng.integers(0, 3)), replace=False):
            own[at] = "changed"
        text = [f"f{rng.integers(9999)}" for _ in range(int(rng.integers(0, 400)))]
        at = int(rng.integers(len(text) + 1))
        ws = text[:at] + own + text[at:]
        rows.append((d, " ".join(ws)))
        found = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
        for i, item in enumerate(items):
            need = {tuple(item[j : j + 5]) for j in range(len(item) - 4)}
            if len(need & found) >= 0.8 * len(need):
                want.add((d, i))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, i) for r in decontaminate.contamination(frame, bench).collect() for i in r.item_ids}
    assert got == want and want


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    x = np.concatenate([x, x[:30] + 0.15 * rng.normal(size=(30, 8)), x[:5], 3 * x[5:9]]).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None]), (904, [float("nan")] * 8), (905, [1.0, 2.0]), (None, rows[0][1])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in vectors.near_vectors(frame, visit=2.0).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    part = np.arange(len(u))
    for _ in range(len(u)):
        part = np.array([min(part[i], *part[close[i]]) if close[i].any() else part[i] for i in range(len(u))])
    assert [got[i].n_links for i in range(len(u))] == close.sum(1).tolist()
    assert [got[i].component_id for i in range(len(u))] == part.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(900, 906))
    assert got[None].component_id is None and got[None].kept and got[None].n_links == 0
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_vector_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.orderBy("vec_id").toPandas()
    u = vectors.unit_rows(np.stack(rows.embedding.to_numpy()))
    links = (u @ u.T >= 0.9).sum(1) - 1
    got = vectors.near_vectors(frame).orderBy("vec_id").toPandas().n_links.to_numpy()
    assert (got <= links).all() and got.sum() >= 0.9 * links.sum()


def border_pairs(rng, n, width):
    """Unclustered unit vectors and a partner of each at a cosine just over 0.9."""
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(n, width))
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.95, (n, 1))
    return x, c * x + np.sqrt(1 - c * c) * y


@pytest.mark.parametrize("width", [4, 16, 64])
def test_border_pairs_meet_among_hundreds_of_cells(width):
    rng = np.random.default_rng(7)
    x, y = border_pairs(rng, 4000, width)
    centres = vectors.spherical_kmeans(border_pairs(rng, 10_000, width)[0], vectors.MOST_CELLS)
    margin = vectors.margins(centres, vectors.SIMILAR)
    (a, go_x), (b, go_y) = (vectors.places(v, centres, margin) for v in (x, y))
    at = np.arange(len(x))
    assert (a != b).sum() > 1000 and go_x[at, b].all() and go_y[at, a].all()


def test_vectors_across_borders(spark):
    x, y = border_pairs(np.random.default_rng(8), 600, 16)
    u = np.concatenate([x, y])
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(u)], "vec_id long, embedding array<double>")
    links = ((u @ u.T >= 0.9).sum(1) - 1).tolist()
    for size in ({}, {"block": 24}):
        got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame, **size).collect()}
        assert [got[i] for i in range(len(u))] == links


def test_token_counts(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b <|STARTOFTEXT|>", "aaaaaaaaa 'S don'T 12३", "x\u0301 \u0301y\x1c\x85z\u3000", "ΑΣ ΟΔΟΣ İ 한글 漢字🙂👍🏽"]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    want = Counter()
    for i, t in [r[:2] for r in EDGE] + list(enumerate(texts, 100)):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 2048)] += 1
    assert Counter(tuple(r) for r in token_counts.token_counts(frame, path).collect()) == want
    assert token_counts.token_counts(none, path).count() == 0


def test_mixing(spark, docs, none):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mixed(rows).toPandas()
    size = {r.doc_id: len(words(r.text)) for r in rows.collect()}
    assert got["size"].tolist() == [size[i] for i in got.doc_id] and (got.taken == got.copies * got["size"]).all()
    assert got.copies.between(0, 3).all()
    sources = got.groupby("source")["size"].sum().sort_index()
    weight = np.array([5.0, 2.0, 1.0] * 40)[: len(sources)]
    want, total = np.zeros(len(sources)), float(sources.sum())
    full = np.zeros(len(sources), bool)
    while True:
        want = np.where(full, 3.0 * sources, (total - 3.0 * sources[full].sum()) * weight / weight[~full].sum())
        if not (above := (want > 3.0 * sources) & ~full).any():
            break
        full |= above
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max")).sort_index()
    assert np.allclose(by.target, want) and (abs(by.taken - by.target) <= np.maximum(by.most, 50)).all()
    again = mixing.mixed(rows.repartition(7)).toPandas().set_index("doc_id").copies
    assert (again.sort_index() == got.set_index("doc_id").copies.sort_index()).all()
    edge = mixing.mixed(docs)
    assert edge.count() == len(EDGE) and {"key", "node"} <= set(edge.columns)
    assert mixing.mixed(none).count() == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><a href="/">Home</a><a href="/x">Far &amp; near</a></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>A &lt;title&gt;</h1><p>First&nbsp;line<br>second <b>bold<p>Ok.<script>var a="</p>";</script><ul><li>One point.</ul>
    <div class="comments"><p>I think that this is a very long comment by a reader, and it goes on, and on.</p></div></article>
    <form><p>Sign up</p><input></form><aside><p>Read more here</p></aside><footer>&copy; 2024 all</footer>"""
    assert html_text.main_text(page) == "A <title>\n\nFirst line second bold\n\nOk.\n\nOne point."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav><p") == ""
    assert html_text.main_text("<p>" + "long text " * 50_000).startswith("long text long")


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        s, t = rng.integers(0, 9, n).tolist(), rng.integers(0, 9, n).tolist()
        edges = [(i, j, int(rng.integers(0, 5))) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            own = sum(t[i] if side[i] else s[i] for i in range(n))
            return own + sum(c for a, b, c in edges if side[a] != side[b])

        best = min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))
        assert cost(html_text.minimum_cut(s, t, edges)) == best


def test_pages(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.extracted(spark.createDataFrame(rows).withColumnRenamed("x", "y")).collect()}
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<(?!/?(p|h1)\b)[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id].text == "\n\n".join(x for x in parts if x) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_urls(spark):
    rows = [
        (1, "HTTP://A.Example.ORG/en/1?x"), (2, "http://example.org/es/"), (3, "http://xexample.org"), (4, "x://y.com/fr/a#b"),
        (5, "x://com/de/"), (6, None), (7, "no scheme"), (None, "http://a.net/q"), (1, "http://z.com/FR/"), (8, "://"),
    ]
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.filtered(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows)
    assert got[(1, "a.example.org", "/en/1")] == ("example.org/en/1", "block") and got[(2, "example.org", "/es/")][0] == "example.org/es/"
    assert got[(3, "xexample.org", "")][0] is None and got[(4, "y.com", "/fr/a")] == ("com/fr/", "allow")
    assert got[(5, "com", "/de/")] == ("com/de/", "block") and got[(1, "z.com", "/FR/")][0] is None
    assert (6, "", "") in got and (7, "", "") in got and (8, "", "") in got and {v for _, v in got.values()} <= {"allow", "block"}
    assert urls.filtered(spark.createDataFrame([], "page_id long, url string")).count() == 0


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n1 = int(label.sum())
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_classifiers(spark, docs, none):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    known = labels.toPandas()
    for name, label, least in (("op4_toxicity", "toxic", 0.97), ("op8_quality", "quality", 0.99)):
        got = QUERIES[name](spark, folder).toPandas()
        both = got[got.held_out].merge(known, on="doc_id")
        assert auc(both.score.to_numpy(), both[label].to_numpy()) > least and got.score.between(0, 1).all()
        assert len(got) == 10_000 and got.predicted.isin([0, 1]).all()
    for run in (toxicity.toxicity, quality.quality):
        assert run(docs, labels).count() == len(EDGE) and run(none, labels).count() == 0
        assert {r.score for r in run(docs, labels.limit(0)).collect()} == {0.5}


def test_pipeline(spark, docs):
    docs_in = spark.read.parquet(f"{DATA}/documents.parquet")
    now = docs_in
    for name, run in corpus_pipeline.STAGES:
        out = run(spark, now, DATA)
        if name != "source_mix":
            assert out.columns == docs_in.columns
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in now.select("doc_id").collect()}
            now = out
    final = out.toPandas()
    assert len(final) and (final.groupby(["doc_id"])["copy"].max() == final.groupby("doc_id").copies.first()).all()
    assert sorted(QUERIES["pipeline"](spark, DATA).toPandas().doc_id) == sorted(final.doc_id)
    for _, run in corpus_pipeline.STAGES:  # edge cases pass every stage
        run(spark, docs.select(*docs_in.columns), DATA).collect()
