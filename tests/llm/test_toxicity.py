"""FTRL-proximal against a plain loop, and what the scores are worth on held-out rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from weekloom.llm import toxicity
from weekloom.llm.queries import QUERIES


def test_ftrl_equals_a_plain_loop_over_coordinates(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 1.5)
    rng = np.random.default_rng(5)
    rows = [(np.unique(np.concatenate([[0], rng.integers(1, 40, 6)])), float(rng.integers(0, 2))) for _ in range(60)]
    w, n = toxicity.ftrl(rows, epochs=2)
    z_, n_ = {}, {}

    def weight(i):
        z = z_.get(i, 0.0)
        if abs(z) <= toxicity.L1:
            return 0.0
        return -(z - math.copysign(toxicity.L1, z)) / ((toxicity.BETA + math.sqrt(n_.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(rows)):
            at, y = rows[k]
            old = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-sum(old.values()))) - y
            for i, wi in old.items():
                before = n_.get(i, 0.0)
                sigma = (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA
                z_[i] = z_.get(i, 0.0) + g - sigma * wi
                n_[i] = before + g * g
    assert {i: w[i] for i in z_} == pytest.approx({i: weight(i) for i in z_}, abs=1e-9)
    assert {i: n[i] for i in n_} == pytest.approx(n_) and (w[0] != 0 or np.count_nonzero(w) > 3)
    assert np.count_nonzero(w) < np.count_nonzero(n)  # the penalty leaves weights at zero


@pytest.mark.parametrize("size, least", [("0.1", 0.8), ("0.01", 0.01)])
def test_held_out_rows(spark, size, least):
    folder = f"/root/testdata/sf{size}"
    got = QUERIES["op4_toxicity"](spark, folder).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (got.predicted == (got.score >= 0.5)).all()
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").toPandas().dropna()
    both = got[got.held_out].merge(known, on="doc_id")
    bad, good = both[both.toxic == 1], both[both.toxic == 0]
    assert bad.predicted.mean() >= least and good.predicted.mean() < 0.01
    assert ((both.score - both.toxic) ** 2).mean() < 0.02 if size == "0.1" else len(bad) > 0
