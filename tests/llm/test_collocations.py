"""Phrases against a plain count of all runs of words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weekloom.llm import collocations
from weekloom.session import workers_find_package

SCHEMA = "text string, lang string"


@pytest.fixture(autouse=True)
def _package(spark):
    workers_find_package(spark)


def brute(rows, most=5, least=100, top=2000, percent=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, most + 1):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731,B023
            if any(len(q) > len(p) and 100 * b >= percent * a and inside(q) for q, b in cands.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed=1, docs=60):
    rng = np.random.default_rng(seed)
    words = np.array(["The", "of", "and", "é", "ÀB", "New", "York", "city", "hall", "x", "\x01y", "a b", "z\x1fz", "in"])
    share = np.arange(len(words), 0, -1) / np.arange(len(words), 0, -1).sum()
    rows = []
    for i in range(docs):
        parts = []
        for w in rng.choice(words, 120, p=share):
            parts.append(str(w))
            parts.append(str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " new york city "], p=[0.7, 0.1, 0.05, 0.05, 0.02, 0.03, 0.05])))
        rows.append(("".join(parts), ["en", "de", None][i % 3]))
    return rows


@pytest.mark.parametrize("hot", [None, 1, 3])
def test_phrases_equal_a_plain_count(spark, monkeypatch, hot):
    if hot:  # every leading pair, or many of them, is routed by more words
        monkeypatch.setattr(collocations, "SAMPLED", 4)
        monkeypatch.setattr(collocations, "GROUP_WORDS", 4 * hot)
    rows = texts()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, percent in ((12, 100), (9, 60)):
        got = sorted(tuple(r) for r in collocations.collocations(frame, least=least, percent=percent).drop("size").collect())
        assert got == brute(rows, least=least, percent=percent) and len(got) > 20


def test_slices_do_not_matter(spark, monkeypatch):
    rows = texts(5)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(2)
    want = brute(rows, least=10, top=7)
    monkeypatch.setattr(collocations, "SLICE", 500)
    got = sorted(tuple(r) for r in collocations.collocations(frame, least=10, top=7).drop("size").collect())
    assert got == want


def test_a_hot_pair_with_many_followers(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SAMPLED", 2)
    monkeypatch.setattr(collocations, "GROUP_WORDS", 400)
    rows = [(f"hot pair n{i % 7} m{i % 3} k{i}. other words", "en") for i in range(1500)]
    got = sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(rows, SCHEMA)).drop("size").collect())
    assert got == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 50}" for i in range(100_000))
    rows = [(None, "en"), ("", "en"), (" \t\n .,;", None), (long, "en"), ("one two", ""), ("a b " * 300, None), ("A B " * 300, None)]
    rows += [("tie one", "xx")] * 100 + [("tie two", "xx")] * 100
    extra = "word string, n long, grp long, route int, size int, rank long"
    frame = spark.createDataFrame([(*r, "w", 1, 2, 3, 4, 5) for r in rows], f"{SCHEMA}, {extra}").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(frame).drop("size").collect())
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] == "xx"] == ["tie one", "tie two"]
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_arithmetic_beyond_64_bits(spark):
    big = 3 * 10**15 + 1
    phrases = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 2), ("en", "b", 1, big + 7)], "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 7 * 10**16 + 3)], "lang string, words long")
    row = collocations.scored(phrases, totals).first()
    assert row.score == 1000 * big * (7 * 10**16 + 3) // ((big + 2) * (big + 7))


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 4, (3000, 5))
    rows *= np.logical_and.accumulate(rng.random((3000, 5)) < [1, 1, 0.8, 0.8, 0.8], axis=1)
    weights = rng.integers(1, 5, 3000)
    want = Counter()
    for r, w in zip(rows.tolist(), weights.tolist(), strict=True):
        for k in range(2, 6):
            if r[k - 1]:
                want[tuple(r[:k])] += w
    for least, route in ((1, 2), (60, 2), (60, 4)):
        got = dict(collocations.frequent_prefixes(rows, weights, least, route))
        assert got == {p: n for p, n in want.items() if n >= least or len(p) < route}
