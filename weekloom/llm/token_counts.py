"""Token counts by rank-synchronous array merging.

A task takes the distinct words of a slice of texts, lets the vocabulary file's own normaliser and splitter cut them
into pre-tokens, and holds the symbols of all new pre-tokens as one ragged array. In each step every sequence applies its
lowest-ranked pair at once, wherever it stands in the sequence; sequences without a pair that merges are done. The
symbols that survive are the tokens. Counts of frequent words are kept by the task.

The vocabulary is a fixed file of bounded size that every worker reads once; only its path is sent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.words import binary, slices

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
KEPT_WORDS = 300_000  # words whose count a task keeps
NO_RANK = np.iinfo(np.int64).max


def merge_all(symbols: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> np.ndarray:
    """Number of symbols left in each sequence after all merges.

    symbols: ids of all sequences, one after another; lengths: of each sequence. pairs: ascending keys left << 32 | right,
    with the rank of each and the symbol it makes. Where a pair overlaps itself (a a a) the leftmost one merges.
    """
    counts = lengths.astype(np.int64).copy()
    alive = np.arange(len(lengths))
    while len(symbols):
        owner = np.repeat(np.arange(len(alive)), counts[alive])
        key = (symbols[:-1].astype(np.int64) << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        rank = np.where((pairs[at] == key) & (owner[:-1] == owner[1:]), ranks[at], NO_RANK)
        rank = np.append(rank, NO_RANK)  # the last symbol begins no pair
        starts = np.concatenate([[0], np.cumsum(counts[alive])[:-1]])
        best = np.minimum.reduceat(rank, starts)
        hit = (rank == best[owner]) & (rank != NO_RANK)
        if not hit.any():
            break
        # Of a run of hits one after another the first, third, ... merge: their second symbols are taken by then.
        place = np.arange(len(hit))
        first = hit & ~np.concatenate([[False], hit[:-1]])
        run_start = np.maximum.accumulate(np.where(first, place, 0))
        hit &= (place - run_start) % 2 == 0
        left = np.nonzero(hit)[0]
        symbols = symbols.copy()
        symbols[left] = made[at[left]]
        keep = np.ones(len(symbols), bool)
        keep[left + 1] = False
        counts[alive] -= np.bincount(owner[left], minlength=len(alive))
        # Sequences that had nothing to merge, or are down to one symbol, are done.
        go_on = (best != NO_RANK) & (counts[alive] > 1)
        keep &= go_on[owner]
        symbols = symbols[keep]
        alive = alive[go_on]
    return counts


class Counter:
    """Counts tokens of whole words (runs without ASCII white space) by one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        library = Tokenizer.from_file(path)
        self.normal, self.cut = library.normalizer, library.pre_tokenizer
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.vocab, self.suffix = vocab, suffix
        left = np.array([(vocab[a] << 32) | vocab[b] for a, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        order = np.argsort(left, kind="stable")
        self.pairs, self.ranks, self.made = left[order], order.astype(np.int64), made[order]
        self.words: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}

    def _cut(self, text: str) -> list[str]:
        return [p for p, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(text))] if text else []

    def _learn(self, words: list[bytes]) -> None:
        """Count the tokens of words that are not known yet."""
        if len(self.words) + len(words) > KEPT_WORDS:
            self.words.clear()
            self.pieces.clear()
        cut, extra = [], []
        for w in words:
            text = w.decode()
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            cut.append([p for part in parts for p in self._cut(part)])
        new = list(dict.fromkeys(p for pieces in cut for p in pieces if p not in self.pieces))
        if new:
            # An unknown symbol is dropped, as the library does without an unknown token.
            ids = [[s for s in (*map(self.vocab.get, p[:-1]), self.vocab.get(p[-1] + self.suffix)) if s is not None] for p in new]
            lengths = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter((s for x in ids for s in x), np.int64, int(lengths.sum()))
            counts = np.zeros(len(new), np.int64)
            counts[lengths > 0] = merge_all(flat, lengths[lengths > 0], self.pairs, self.ranks, self.made)
            self.pieces.update(zip(new, counts.tolist(), strict=True))
        for w, pieces, n in zip(words, cut, extra, strict=True):
            self.words[w] = n + sum(self.pieces[p] for p in pieces)

    def count(self, texts: list[bytes | None]) -> list[int]:
        split = [t.split() if t else [] for t in texts]
        known = self.words
        new = list({w for ws in split for w in ws if w not in known})
        if new:
            if len(known) + len(new) > KEPT_WORDS:
                new = list({w for ws in split for w in ws})
            self._learn(new)
        return [sum(map(self.words.__getitem__, ws)) for ws in split]


COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of (doc_id, text).

    Tokens are those of the vocabulary file without begin and end tokens; its special strings count as one token each
    where they stand in a text. Null or empty text: 0 bytes, 0 tokens. Repeated rows and null doc_ids stay as rows of
    their own, extra columns are ignored, an empty table gives no rows. No shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = COUNTERS.get(path) or COUNTERS.setdefault(path, Counter(path))
        for batch in batches:
            for part in slices(batch):
                n = pa.array(counter.count(binary(part.column("text"))), pa.int64())
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.record_batch(
                    [part.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
