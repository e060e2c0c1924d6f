"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

The statistics of a labelled sample of bounded size are standardised and mapped to random Fourier features, whose inner products approximate a Gaussian kernel. Each partition adds up its part of the normal equations,
Spark adds up the parts row by row, and the driver solves one system of fixed size. Ridge scores of the sample, counted
in a fixed number of bins with their labels, are calibrated by pooling adjacent violators. The model, a few hundred
kilobytes, goes to all tasks, which score the documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.labelled import held_out, training_labels
from weekloom.llm.words import binary, slices
from weekloom.session import stage

FIT_ROWS = 40_000  # labelled documents used for learning, expected
FIT_PARTS = 8
FOURIER = 192
WIDTH = 4.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1e-3
BINS = 1000
THRESHOLD = 0.3

KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "mark": b"!?",
    "bar": b"|",
    "sign": b"#$%&*+=<>@\\^_`~{}[]/",
}
KIND_OF = np.full(256, len(KINDS), np.int64)  # the last kind: bytes of other characters
for _k, _bytes in enumerate(KINDS.values()):
    KIND_OF[list(_bytes)] = _k
N_STATS = len(KINDS) + 1 + 14


def statistics(text: bytes | None) -> np.ndarray:
    """Fixed-length numbers that describe a text; all 0 for an empty one."""
    out = np.zeros(N_STATS)
    words = text.split() if text else []
    if not words:
        return out
    raw = np.frombuffer(text, np.uint8)
    kinds = np.bincount(KIND_OF[raw], minlength=len(KINDS) + 1) / len(raw)
    out[: len(kinds)] = np.sqrt(kinds)
    size = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x]
    per_line = np.fromiter(map(len, lines), np.int64, len(lines))
    n, k = len(words), len(kinds)
    out[k:] = (
        np.log1p(n),
        np.log1p(len(lines)),
        size.mean(),
        size.std(),
        (size <= 3).mean(),
        (size == 1).mean(),
        (size > 20).mean(),
        np.log1p(size.max()),
        len(set(words)) / n,
        len(set(words[:-1:2])) / max(1, len(words[:-1:2])),
        1 - len(set(lines)) / len(lines),
        np.log1p(per_line.mean()),
        np.log1p(per_line.std()),
        sum(x[-1:] in b".!?" for x in lines) / len(lines),
    )
    return out


def _stats(part: pa.RecordBatch) -> np.ndarray:
    texts = binary(part.column("text"))
    return np.array([statistics(t) for t in texts]).reshape(len(texts), N_STATS)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.record_batch(
                [pa.array(list(_stats(part)), pa.list_(pa.float64())), part.column("target")], ["stats", "target"]
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_STATS)


class Kernel:
    """Standardised statistics and their random Fourier features, the same for the same seed."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int = FOURIER, width: float = WIDTH):
        rng = np.random.default_rng(11)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.waves = rng.normal(size=(len(mean), features)) / width
        self.phases = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -6, 6)
        waves = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, 0.1 * z, np.ones((len(z), 1))])


def _sum_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist()], axis=0)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def normal_equations(sample: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """Phi' Phi and Phi' y, each partition's part added up by Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                phi = kernel(_matrix(batch.column("stats")))
                own = phi.T @ np.hstack([phi, batch.column("target").to_numpy()[:, None]])
                total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch(
                [pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "sums"]
            )

    rows = sample.mapInArrow(part, "i int, sums binary").groupBy("i").applyInArrow(_sum_rows, "i int, sums binary")
    both = np.array([np.frombuffer(r.sums, np.float64) for r in sorted(rows.collect())])
    return both[:, :-1], both[:, -1]


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit to the values by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def calibrate(raw: np.ndarray, at: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The fitted level at each raw score; a hundredth of it follows the raw score, so that ties keep their order."""
    return 0.99 * np.interp(raw, at, level) + 0.01 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS):
    """A function from statistics to scores, or None where nothing is labelled."""
    ids = F.broadcast(training_labels(labels, "quality", rows))  # at most about ``rows`` pairs of numbers
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    sample = stage(known.select("text", "target").mapInArrow(_describe, "stats array<double>, target double"))
    sample = sample.coalesce(FIT_PARTS)
    columns = [f(F.col("stats")[i]).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(N_STATS)]
    got = sample.agg(F.count("*").alias("n"), *columns).first()
    if not got.n:
        return None
    kernel = Kernel(np.array(got[1 : 1 + N_STATS]), np.array(got[1 + N_STATS :]))
    gram, right = normal_equations(sample, kernel)
    w = np.linalg.solve(gram + RIDGE * got.n * np.diag([1.0] * (len(gram) - 1) + [0.0]) + 1e-9 * np.eye(len(gram)), right)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = kernel(_matrix(batch.column("stats"))) @ w
            at = np.clip(np.floor(raw * BINS), -BINS, 2 * BINS).astype(np.int64)
            yield pa.record_batch([pa.array(at), pa.array(raw), batch.column("target")], ["bin", "raw", "target"])

    counted = sample.mapInArrow(bins, "bin long, raw double, target double").groupBy("bin")
    counted = counted.agg(F.avg("raw").alias("raw"), F.avg("target").alias("y"), F.count("*").alias("n")).toPandas().sort_values("bin")
    at = counted["raw"].to_numpy(float)
    level = isotonic(counted["y"].to_numpy(float), counted["n"].to_numpy(float))
    return lambda stats: calibrate(kernel(stats) @ w, at, level)


def _scores(part: pa.RecordBatch, model) -> np.ndarray:
    if model is None or not part.num_rows:
        return np.full(part.num_rows, 0.5)
    return np.clip(model(_stats(part)), 0, 1)


def quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every row of (doc_id, text).

    Null and empty texts have statistics of 0 and are scored by them. Without a labelled row every score is 0.5. A null
    doc_id is not held out and never learnt from. Repeated rows get equal scores; extra columns are ignored; an empty
    table gives no rows.
    """
    model = fit(docs, labels, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                s = _scores(part, model)
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.withColumn("held_out", held_out()).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the classifier accepts, with all their columns; defined as in ``quality``."""
    model = fit(docs, labels, rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(_scores(part, model) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
