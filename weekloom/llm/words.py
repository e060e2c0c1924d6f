"""Words, hashes and bounded slices of Arrow batches, shared by the operators that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20  # text that is held as Python words at one time; a longer document is a slice of its own
CACHE_WORDS = 200_000  # distinct words whose hash is kept by a task
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word (bytes); the most recent words are kept, up to ``CACHE_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch | pa.Table, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces whose text is at most ``most`` bytes, but of one row at least."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def lower(text: bytes) -> bytes:
    """A to Z in lower case, all other bytes unchanged."""
    return text.lower()


def split(texts: list[bytes | None], lowered: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of the texts, and where each text's words end and begin (n + 1 offsets)."""
    words: list[bytes] = []
    offsets = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            words += (t.lower() if lowered else t).split()
        offsets[i + 1] = len(words)
    return words, offsets


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words; of the whole sequence if it is shorter, none if it is empty."""
    n = min(n, len(hashes))
    if n == 0:
        return hashes[:0]
    out = np.full(len(hashes) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        out = mix(out * GOLDEN + hashes[k : len(hashes) - n + 1 + k])
    return out
