"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, word openings, word pairs and pairs with one word between, hashed into
2**20 slots. FTRL-proximal, with a learning rate for each coordinate and an L1 penalty that leaves most weights at exactly
zero, runs over the labelled rows, a sample of bounded size, one after the other in one task: dealt to several shards, the
few rows with label 1 would not reach the penalty's height in any of them. With more shards (``shards``, for larger
samples) their weights are averaged coordinate by coordinate, in proportion to the squared gradients that a shard has
seen. The non-zero weights (at most 2**20 + 1, some thousands in practice) go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.labelled import held_out, training_labels
from weekloom.llm.words import GOLDEN, binary, mix, slices

FIT_ROWS = 24_000  # labelled documents used for learning, expected
SHARDS = 1
SLOT_BITS = 20
SLOTS = (1 << SLOT_BITS) + 1  # slot 0 is the constant
EPOCHS = 6
ALPHA, BETA, L1, L2 = 0.3, 1.0, 14.0, 0.1
OPENINGS = (5, 8)  # bytes of a word's opening
PARTS = b".,!?;:\"'()[]{}|#$%&*-_/\\<>@+=~`^0123456789"


class Features(dict):
    """Row number of a word in ``hashes``: the word's own hash and those of its openings, 0 where it has none."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.hashes = np.zeros((most, 1 + len(OPENINGS)), np.uint64)

    def _learn(self, words: list[bytes]) -> None:
        one = xxhash.xxh3_64_intdigest
        plain = [w.strip(PARTS) for w in words]
        at = slice(len(self), len(self) + len(words))
        self.hashes[at, 0] = [one(p) for p in plain]
        for k, n in enumerate(OPENINGS, 1):
            self.hashes[at, k] = [one(b"^" + p[:n]) if len(p) > n else 0 for p in plain]
        self.update(zip(words, range(at.start, at.stop), strict=True))

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(words) > len(self.hashes):
            return Features(len(words)).of(words)
        if len(self) + len(words) > len(self.hashes):
            self.clear()
        if new := [w for w in dict.fromkeys(words) if w not in self]:
            self._learn(new)
        return self.hashes[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


CACHE = Features()


def slots(text: bytes | None) -> np.ndarray:
    """The distinct feature slots of a text, in ascending order; slot 0 is the constant."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(1, np.int64)
    table = CACHE.of(words)
    word = table[:, 0]
    pairs = mix(word[:-1] * GOLDEN + word[1:])
    skips = mix(word[:-2] * GOLDEN + word[2:] + np.uint64(1))
    found = (np.concatenate([table[table != 0], pairs, skips]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    found.sort()
    new = np.ones(len(found) + 1, bool)
    new[2:] = found[1:] != found[:-1]
    return np.concatenate([[0], found + 1])[new]


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, float]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and summed squared gradients after some passes over (slots, target)."""
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, y = rows[i]
            w = weights(at)
            g = sigmoid(w.sum()) - y
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(SLOTS)), n


def _fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("doc_id")  # the same result whatever the order of arrival
    rows = []
    for part in slices(table):
        rows += zip(map(slots, binary(part.column("text"))), part.column("target").to_pylist(), strict=True)
    w, n = ftrl(rows)
    at = np.nonzero(n)[0]
    at = at[(w[at] != 0) | (n[at] > 0)]
    return pa.table({"slot": pa.array(at), "top": pa.array(w[at] * n[at]), "below": pa.array(n[at])})


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their non-zero weights, from the labelled documents that are not held out."""
    sample = training_labels(labels, "toxic", rows)
    known = docs.join(F.broadcast(sample), "doc_id")  # at most about ``rows`` pairs of numbers
    dealt = known.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    fitted = dealt.groupBy("shard").applyInArrow(_fit, "slot long, top double, below double")
    mean = fitted.groupBy("slot").agg((F.sum("top") / F.sum("below")).alias("w")).where(F.col("w") != 0).toPandas()
    mean = mean.sort_values("slot")
    return mean["slot"].to_numpy(np.int64), mean["w"].to_numpy(np.float64)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of (doc_id, text).

    score is the model's probability of label 1; predicted is 1 from 0.5 on. Null and empty texts have the constant
    feature only and get its score. Without a labelled row every score is 0.5. A null doc_id is not held out and never
    learnt from. Repeated rows get equal scores; extra columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at, w = fit(own, labels, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(SLOTS)
        dense[at] = w
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in binary(part.column("text")):
                    s = slots(text)
                    found.append(float(sigmoid(dense[s].sum())))
                predicted = pa.array([int(x >= 0.5) for x in found], pa.int32())
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("held_out"), pa.array(found, pa.float64()), predicted],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows_in = own.withColumn("held_out", held_out())
    return rows_in.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
