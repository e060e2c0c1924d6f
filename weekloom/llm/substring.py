"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window is ``length`` consecutive words of one document. A word goes if it is covered by a window whose word sequence
also starts in a document with a smaller doc_id. Windows are judged on the input.

Plan, three shuffles and no pairs of documents:

1. documents are dealt into batches by a hash of doc_id and text, so that rows without a doc_id, or with one that repeats,
   spread as well; only equal rows stay together. A batch hashes all windows of its documents with a rolling
   polynomial and sends each *distinct* hash once, with the smallest doc_id that has it here, to a bucket of the hash.
   So a window that a third of all documents share arrives once per batch, not once per document;
2. a bucket counts each hash: if a smaller doc_id exists in another batch, the answer for (batch, hash) is yes. Answers
   go back as one bit per hash;
3. documents meet the answers of their batch. With a yes every occurrence in the batch goes; with a no the batch's own
   smallest doc_id keeps its words and the other documents of the batch lose them. Covered words merge into maximal
   intervals.

Hashes have 64 bits; two different windows are taken as equal with a chance of 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.llm.words import WordHashes, binary, mix, slices

WINDOW = 50
BATCH_DOCS = 256
BUCKET_DOCS = 16_384  # documents whose distinct windows a bucket of hashes holds, about, however many documents there are
BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
LAST = np.iinfo(np.int64).max


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of each window of ``length`` word hashes."""
    n = len(words)
    if n < length:
        return words[:0]
    up = np.full(n + 1, np.uint64(BASE))
    up[0] = 1
    up = np.cumprod(up)
    down = np.full(n, np.uint64(pow(BASE, -1, 1 << 64)))
    down[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * np.cumprod(down), out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * up[length - 1 : n])


CACHE = WordHashes()


def _documents(table: pa.Table, length: int) -> Iterator[tuple[int | None, bytes, list[bytes], np.ndarray]]:
    """doc_id, text, words and window hashes of each row."""
    for part in slices(table):
        ids = part.column("doc_id").to_pylist()
        for doc_id, text in zip(ids, binary(part.column("text")), strict=True):
            words = text.split() if text else []
            yield doc_id, text or b"", words, window_hashes(CACHE.of(words), length)


def _distinct(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct window hashes of a batch in ascending order, and the smallest doc_id of each."""
    hashes, docs = [], []
    for doc_id, _, _, h in _documents(table, length):
        if len(h):
            h = np.unique(h)
            hashes.append(h)
            docs.append(np.full(len(h), LAST if doc_id is None else doc_id))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    return h[first], d[first]


def _bucket_starts(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where the hashes of each bucket begin in the ascending hashes: buckets are ranges of the hash."""
    bounds = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])


SENT = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("batch", T.LongType()),
        T.StructField("hashes", T.BinaryType()),
        T.StructField("docs", T.BinaryType()),
        T.StructField("runs", T.BinaryType()),
    ]
)
ANSWER = "batch long, bucket int, yes binary"


def _send(length: int, buckets: int):
    schema = pa.schema(
        [("bucket", pa.int32()), ("batch", pa.int64()), ("hashes", pa.binary()), ("docs", pa.binary()), ("runs", pa.binary())]
    )

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h, d = _distinct(table, length)
        at = _bucket_starts(h, buckets)
        rows: dict[str, list] = {name: [] for name in schema.names}
        for b in np.nonzero(np.diff(at))[0]:
            part, docs = h[at[b] : at[b + 1]], d[at[b] : at[b + 1]]
            order = np.argsort(docs, kind="stable")  # by document, so that doc_ids are sent as runs
            names, runs = np.unique(docs, return_counts=True)
            rows["bucket"].append(int(b))
            rows["batch"].append(key[0].as_py())
            rows["hashes"].append(part[order].tobytes())
            rows["docs"].append(names.tobytes())
            rows["runs"].append(runs.astype(np.int32).tobytes())
        return pa.table(rows, schema=schema)

    return send


def _judge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For each hash of each batch: does a document with a smaller doc_id in another batch have it?"""
    batches = table.column("batch").to_pylist()
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    docs = [
        np.repeat(np.frombuffer(a, np.int64), np.frombuffer(b, np.int32))
        for a, b in zip(table.column("docs").to_pylist(), table.column("runs").to_pylist(), strict=True)
    ]
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(h, kind="stable")
    starts = np.ones(len(h), bool)
    starts[1:] = h[order][1:] != h[order][:-1]
    least = np.minimum.reduceat(d[order], np.nonzero(starts)[0])
    yes = np.empty(len(h), bool)
    yes[order] = d[order] > least[np.cumsum(starts) - 1]
    ends = np.cumsum([len(x) for x in hashes])[:-1]
    answers = []
    for part, own in zip(np.split(yes, ends), hashes, strict=True):
        answers.append(np.packbits(part[np.argsort(own, kind="stable")]).tobytes())  # bits by ascending hash
    return pa.table(
        {
            "batch": pa.array(batches, pa.int64()),
            "bucket": pa.array([key[0].as_py()] * len(batches), pa.int32()),
            "yes": pa.array(answers, pa.binary()),
        }
    )


def covered(windows: np.ndarray, n_words: int, length: int) -> list[tuple[int, int]]:
    """Maximal intervals of words (first, one past the last) that the marked windows cover."""
    at = np.nonzero(windows)[0]
    if not len(at):
        return []
    cuts = np.nonzero(np.diff(at) > length)[0]
    return [(int(a), int(b) + length) for a, b in zip(at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]], strict=True)]


def cut(text: bytes, words: list[bytes], gone: list[tuple[int, int]]) -> bytes:
    """The text without the words of the intervals and the white space after them."""
    if not gone:
        return text
    starts, at = [], 0
    for w in words:
        at = text.index(w, at)
        starts.append(at)
        at += len(w)
    starts.append(len(text))
    kept, last = [], 0
    for a, b in gone:
        kept.append(text[last : starts[a]])
        last = starts[b]
    kept.append(text[last:])
    return b"".join(kept)


def _gone(table: pa.Table, answers: pa.Table, length: int, buckets: int):
    """text, words and the word intervals that go, of each row of a batch."""
    h, least = _distinct(table, length)
    at = _bucket_starts(h, buckets)
    yes = np.zeros(len(h), bool)
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("yes").to_pylist(), strict=True):
        n = at[b + 1] - at[b]
        yes[at[b] : at[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    for doc_id, text, words, own in _documents(table, length):
        gone = []
        if len(own):
            place = np.searchsorted(h, own)
            gone = covered(yes[place] | ((LAST if doc_id is None else doc_id) > least[place]), len(words), length)
        yield text, words, gone


def _report(length: int, buckets: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("kept_sha256", pa.string()),
            ("spans", pa.list_(pa.list_(pa.int64()))),
        ]
    )

    def report(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {name: [] for name in schema.names}
        rows["doc_id"] = table.column("doc_id").to_pylist()
        for _, words, gone in _gone(table, answers, length, buckets):
            kept, last = [], 0
            for a, b in gone:
                kept += words[last:a]
                last = b
            kept += words[last:]
            rows["n_words"].append(len(words))
            rows["n_removed"].append(len(words) - len(kept))
            rows["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            rows["spans"].append([list(x) for x in gone])
        return pa.table(rows, schema=schema)

    return report


def _rewrite(length: int, buckets: int, counted: str | None):
    def rewrite(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table.column("text").to_pylist()
        sizes = table.column(counted).to_pylist() if counted else []
        for i, (text, words, gone) in enumerate(_gone(table, answers, length, buckets)):
            if gone:
                texts[i] = cut(text, words, gone).decode()
                if counted:
                    sizes[i] = len(texts[i])
        new = {"text": texts} | ({counted: sizes} if counted else {})
        for name, values in new.items():
            at = table.schema.get_field_index(name)
            table = table.set_column(at, name, pa.array(values, table.schema.field(name).type))
        return table.drop_columns([BATCH])

    return rewrite


BATCH = "__batch"


def _answered(docs: DataFrame, length: int, batch_docs: int):
    """The documents by batch, the answers by batch, and the number of buckets."""
    n = docs.count()
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_DOCS))
    batches = max(1, -(-n // batch_docs))
    dealt = docs.withColumn(BATCH, F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))
    sent = dealt.groupBy(BATCH).applyInArrow(_send(length, buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_judge, ANSWER)
    return dealt.groupBy(BATCH), answers.groupBy("batch"), buckets


def repeated_spans(docs: DataFrame, length: int = WINDOW, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (word intervals that go) of every row of (doc_id, text).

    kept_sha256 is that of the kept words joined by one space. Null or empty text: no words, nothing removed, the hash of
    nothing. A null doc_id counts as the largest one, so its words give way to any other document, but not to another
    null. Rows that share a doc_id never remove each other's words. A text of fewer than ``length`` words keeps all.
    Extra columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt, answers, buckets = _answered(own, length, batch_docs)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<array<long>>"
    return dealt.cogroup(answers).applyInArrow(_report(length, buckets), out)


def without_repeats(docs: DataFrame, length: int = WINDOW, batch_docs: int = BATCH_DOCS) -> DataFrame:
    """All rows of (doc_id, text, ...) without the words that ``repeated_spans`` finds; all other characters stay.

    A removed interval goes with the white space after it. n_chars, where it is a column, follows the new text. Other
    columns, and rows that lose nothing, are unchanged.
    """
    dealt, answers, buckets = _answered(docs, length, batch_docs)
    counted = "n_chars" if "n_chars" in docs.columns else None
    return dealt.cogroup(answers).applyInArrow(_rewrite(length, buckets, counted), docs.schema)
