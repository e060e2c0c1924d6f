"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), cut at punctuation into pieces, and pieces into words. Everything is counted per language.

1. One pass over the texts counts words and pairs of neighbours by hash: each slice of text sends its distinct ones with
   their counts, as packed numbers, to the group of their hash. No candidate holds a word or a pair below the least
   frequency, so the others are marked in two bitmaps of fixed size. A mark by chance only costs work.
2. A second pass takes the suffix at each word, at most ``MOST`` words of one piece, ended by the first unmarked pair. Each
   slice sends its distinct suffixes with their counts, packed as numbers over a small word list, to the group of their
   leading words. Leading pairs that are too common for one group, found in a sample of positions, are routed by three
   words, then by four, then by five; counts of phrases shorter than the words routed by are parts, and are added up
   afterwards.
3. A group sorts pointers to its suffixes by multikey three-way quicksort: a partition around a word has an equal part,
   whose weight is the count of the phrase so far and which goes on one word deeper. Partitions whose weight is below the
   least frequency are abandoned.
4. Cuts, scores and contained phrases are joins over the table of frequent phrases.

Memory of a task: a slice of text, or one group. The driver sees the bitmaps (9 MiB) and the hashes of the common leading
words: at most one for every ``GROUP_WORDS`` words of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.words import GOLDEN, binary, mix, slices
from weekloom.operators.lookup import SALTS, lookup_join
from weekloom.session import stage

MOST = 5  # words of a phrase
LEAST = 100  # occurrences of a candidate
TOP = 2000  # phrases of a language
COVERED = 100  # per cent of a phrase's occurrences inside a longer one that drop it
GROUP_WORDS = 2_000_000  # words of text to a group, expected
WORD_BYTES = 5  # of text to a word, for the number of groups
SAMPLED = 1024  # one position in so many is sampled, to find common leading words
SLICE = 8 << 20  # bytes of text whose suffixes are combined at one time
BITS = (23, 26)  # bitmaps of words and of pairs
BREAK, BLANK = b"\n", b""
UNKNOWN = "und"
PLAIN = bytes(
    10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


class Numbers(dict):
    """Numbers words in the order in which they are met; 0 ends a piece, 1 is nothing."""

    def __init__(self):
        super().__init__({BREAK: 0, BLANK: 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of the texts, and their numbers in text order with 0 after each piece."""
    known = Numbers()
    found = [np.zeros(1, np.int64)]
    for text in texts:
        tokens = text.translate(PLAIN).replace(BREAK, b" \n ").split(b" ")
        found.append(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
        found.append(np.zeros(1, np.int64))
    ids = np.concatenate(found)
    return list(known), ids[ids != 1]


def _by_language(part: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(part.column("lang").to_pylist(), binary(part.column("text")), strict=True):
        if text:
            texts.setdefault(lang, []).append(text)
    for lang, own in texts.items():
        yield lang, *numbered(own)


def suffixes(ids: np.ndarray, going: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` words at each word that goes on; 0 from the first one on whose word before doesn't go on."""
    padded = np.concatenate([ids, np.zeros(most, ids.dtype)])
    on = np.concatenate([going, np.zeros(most, bool)])
    at = np.nonzero(going)[0]
    out = np.empty((len(at), most), ids.dtype)
    out[:, 0] = ids[at]
    live = np.ones(len(at), bool)
    for k in range(1, most):
        live &= on[at + k - 1]
        out[:, k] = np.where(live, padded[at + k], 0)
    return out


def hashed(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes of the words of a language, 0 for the two numbers that are none; alike in every task."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    one = xxhash.xxh3_64_intdigest
    return np.array([0, 0, *(one(w, seed) for w in words[2:])], np.uint64)[: len(words)]


def leading(own: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(n, k) hashes of the first 1..k words of each row, from the hashes of the words."""
    h = np.zeros(len(rows), np.uint64)
    out = np.empty(rows.shape, np.uint64)
    for k in range(rows.shape[1]):
        h = mix(h * GOLDEN + own[rows[:, k]])
        out[:, k] = h
    return out


def _pairs(words: list[bytes], ids: np.ndarray):
    """Where a pair of neighbours starts, the distinct pairs, the number of each, and their counts."""
    at = np.nonzero((ids[:-1] > 0) & (ids[1:] > 0))[0]
    found, which, n = np.unique(ids[at] * len(words) + ids[at + 1], return_inverse=True, return_counts=True)
    return at, np.stack([found // len(words), found % len(words)], axis=1), which, n


def _group(h: np.ndarray, groups: int) -> np.ndarray:
    return (h % np.uint64(groups)).astype(np.int64)


def _slots(h: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a hash in a bitmap: from its group and its upper half, which is all that is sent."""
    return (mix((group.astype(np.uint64) << np.uint64(32)) + h) >> np.uint64(64 - bits)).astype(np.int64)


def _smallest(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


SENT = [("grp", pa.int64()), ("kind", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("type", pa.string()), ("keys", pa.binary()), ("weights", pa.binary())]
WORD, PAIR, LANG, LEAD = range(4)  # kinds of rows; LEAD + k: leading runs of 2 + k words


def _tell(most: int, groups: int):
    """Counts of words and pairs by hash, words of each language, and at sampled positions the hashes of leading words."""
    schema = pa.schema(SENT)

    def packed(kind: int, h: np.ndarray, n: np.ndarray) -> Iterator[dict]:
        group = _group(h, groups)
        order = np.argsort(group, kind="stable")
        group, h, n = group[order], h[order], n[order]
        keys = h if kind >= LEAD else (h >> np.uint64(32)).astype(np.uint32)
        starts = np.searchsorted(group, np.arange(groups + 1)) if groups < len(h) else np.append(np.nonzero(np.diff(group, prepend=-1))[0], len(h))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a < b:
                own = _smallest(n[a:b])
                yield dict(grp=int(group[a]), kind=kind, type=own.dtype.str, keys=keys[a:b].tobytes(), weights=own.tobytes())

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, most=SLICE):
                found: dict[int, list] = {}
                for lang, words, ids in _by_language(part):
                    n = np.bincount(ids, minlength=len(words))[2:]
                    totals[lang] = totals.get(lang, 0) + int(n.sum())
                    own = hashed(lang, words)
                    every = np.arange(2, len(words))[:, None]
                    found.setdefault(WORD, []).append((leading(own, every)[:, 0], n))
                    at, pairs, _, n = _pairs(words, ids)
                    found.setdefault(PAIR, []).append((leading(own, pairs)[:, 1], n))
                    rng = np.random.default_rng(len(ids))
                    some = at[np.unique(rng.integers(0, len(at), -(-len(at) // SAMPLED)))] if len(at) else at
                    near = np.concatenate([ids, np.zeros(most, ids.dtype)])[some[:, None] + np.arange(most)]
                    near *= np.logical_and.accumulate(near > 0, axis=1)
                    lead = leading(own, near)
                    for k in range(most - 2):
                        found.setdefault(LEAD + k, []).append((lead[:, k + 1], np.ones(len(lead), np.int64)))
                rows = [r for kind, x in found.items() for r in packed(kind, *map(np.concatenate, zip(*x, strict=True)))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
        rows = [dict(grp=xxhash.xxh3_64_intdigest(lang.encode()) % groups, kind=LANG, lang=lang, n=n) for lang, n in totals.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return tell


def _tally(least: int, hot: int):
    schema = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])

    def tally(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = np.int64(key[0].as_py())
        out = []
        totals: dict[str, int] = {}
        kinds = table.column("kind").to_numpy()
        for kind in np.unique(kinds).tolist():
            own = table.filter(pa.array(kinds == kind))
            if kind == LANG:
                for lang, n in zip(own.column("lang").to_pylist(), own.column("n").to_pylist(), strict=True):
                    totals[lang] = totals.get(lang, 0) + n
                continue
            wide = np.uint64 if kind >= LEAD else np.uint32
            h = np.concatenate([np.frombuffer(x, wide) for x in own.column("keys").to_pylist()])
            n = [np.frombuffer(x, t) for x, t in zip(own.column("weights").to_pylist(), own.column("type").to_pylist(), strict=True)]
            n = np.concatenate(n).astype(np.int64)
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            starts = np.nonzero(np.append(True, h[1:] != h[:-1]))[0]
            n, h = np.add.reduceat(n, starts), h[starts].astype(np.uint64)
            often = n >= (hot if kind >= LEAD else least)
            n, h = n[often], h[often]
            keys = h.view(np.int64) if kind >= LEAD else np.unique(_slots(h, np.full(len(h), group), BITS[kind]))
            out += [dict(kind=kind, key=k) for k in keys.tolist()]
        out += [dict(kind=LANG, lang=lang, n=n) for lang, n in totals.items()]
        return pa.Table.from_pylist(out, schema=schema)

    return tally


def _bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    slot = F.col("key") + 1
    rows = slots.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.collect():  # at most 2**bits / 8 bytes
        own = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(own)] = own
    return out


def _marked(bitmap: np.ndarray, h: np.ndarray, groups: int, bits: int) -> np.ndarray:
    slot = _slots(h >> np.uint64(32), _group(h, groups), bits)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


PACKED = "grp long, lang string, route int, words array<binary>, kind string, ids binary, weights binary"


def _send(most: int, groups: int, bitmaps: list[np.ndarray], hot: list[np.ndarray]):
    schema = pa.schema(
        [("grp", pa.int64()), ("lang", pa.string()), ("route", pa.int32()), ("words", pa.list_(pa.binary())), ("kind", pa.string()), ("ids", pa.binary()), ("weights", pa.binary())]
    )

    def packed(lang: str, words: list[bytes], rows: np.ndarray, weights: np.ndarray, route: np.ndarray, h: np.ndarray) -> Iterator[dict]:
        group = _group(h, groups)
        order = np.lexsort((route, group))
        rows, weights, route, group = rows[order], weights[order], route[order], group[order]
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (route[1:] != route[:-1])
        cuts = np.nonzero(new)[0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            used, local = np.unique(rows[a:b], return_inverse=True)
            shift = int(used[0] != 0)  # 0 stays the end of a piece
            own, count = _smallest(local.reshape(b - a, -1) + shift), _smallest(weights[a:b])
            names = [words[w] for w in used[1 - shift :]]
            kind = f"{own.dtype.str} {count.dtype.str}"
            yield dict(
                grp=int(group[a]), lang=lang, route=int(route[a]), words=names, kind=kind, ids=own.tobytes(), weights=count.tobytes()
            )

    def marked(lang: str, words: list[bytes], ids: np.ndarray) -> Iterator[dict]:
        own = hashed(lang, words)
        every = np.arange(2, len(words))[:, None]
        h = leading(own, every)[:, 0]
        often = _marked(bitmaps[WORD], h, groups, BITS[WORD])
        n = np.bincount(ids, minlength=len(words))[2:]
        if often.any():
            yield from packed(lang, words, every[often], n[often], np.ones(int(often.sum()), int), h[often])
        at, pairs, which, _ = _pairs(words, ids)
        going = np.zeros(len(ids), bool)
        if len(at):
            going[at] = _marked(bitmaps[PAIR], leading(own, pairs)[:, 1], groups, BITS[PAIR])[which]
        rows = suffixes(ids, going, most)
        if not len(rows):
            return
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        at = np.nonzero(new)[0]
        weights, rows = np.diff(np.append(at, len(rows))), rows[at]
        lead = leading(own, rows)
        route = np.full(len(rows), 2)
        for k, known in enumerate(hot, 2):  # known: hashes of common leading runs of k words
            route += (route == k) & np.isin(lead[:, k - 1], known)
        yield from packed(lang, words, rows, weights, route, lead[np.arange(len(rows)), route - 1])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE):
                for lang, words, ids in _by_language(part):
                    found = list(marked(lang, words, ids))
                    for k in range(0, len(found), 256):
                        yield pa.RecordBatch.from_pylist(found[k : k + 256], schema=schema)

    return send


def frequent_prefixes(rows: np.ndarray, weights: np.ndarray, least: int, route: int = 2) -> Iterator[tuple[tuple[int, ...], int]]:
    """Prefixes of two words or more with their weight, by multikey three-way quicksort of pointers to the rows.

    Prefixes shorter than ``route`` come out whatever their weight, since the rest of their rows is elsewhere.
    """
    todo = [(np.arange(len(rows)), ())]
    while todo:
        at, prefix = todo.pop()
        depth = len(prefix)
        floor = least if depth + 1 >= route else 1
        word = rows[at, depth]
        if depth:
            at, word = at[word > 0], word[word > 0]
        if not len(at) or (floor > 1 and weights[at].sum() < floor):
            continue  # abandoned
        pivot = word[len(word) // 2]
        same = word == pivot
        if not same.all():
            todo.append((at[word < pivot], prefix))
            todo.append((at[word > pivot], prefix))
            at = at[same]
        weight = int(weights[at].sum())
        if weight >= floor:
            found = (*prefix, int(pivot))
            if depth:
                yield found, weight
            if depth + 1 < rows.shape[1]:
                todo.append((at, found))


PHRASE = "lang string, phrase string, size int, n long, part boolean"


def _mine(most: int, least: int):
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("part", pa.bool_())])

    def mine(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sets: dict[tuple[str, int], list[dict]] = {}
        for row in table.to_pylist():
            sets.setdefault((row["lang"], row["route"]), []).append(row)
        out: dict[str, list] = {name: [] for name in schema.names}
        for (lang, route), own in sets.items():
            known: dict[bytes, int] = {}
            rows, weights = [], []
            for r in own:
                to = np.array([0, *(known.setdefault(w, len(known) + 1) for w in r["words"])], np.int32)
                kinds = r["kind"].split(" ")
                weights.append(np.frombuffer(r["weights"], kinds[1]).astype(np.int64))
                rows.append(to[np.frombuffer(r["ids"], kinds[0]).reshape(len(weights[-1]), -1)])
            names = [b"", *known]
            if route == 1:
                n = np.bincount(np.concatenate(rows)[:, 0], np.concatenate(weights), len(names)).astype(np.int64)
                often = np.nonzero(n >= least)[0]
                for name, values in zip(schema.names, ([lang] * len(often), [names[w].decode() for w in often], [1] * len(often), n[often].tolist(), [False] * len(often)), strict=True):
                    out[name] += values
                continue
            for found, n in frequent_prefixes(np.concatenate(rows), np.concatenate(weights), least, route):
                out["lang"].append(lang)
                out["phrase"].append(b" ".join(names[w] for w in found).decode())
                out["size"].append(len(found))
                out["n"].append(n)
                out["part"].append(len(found) < route)
        return pa.table(out, schema=schema)

    return mine


def frequent_phrases(docs: DataFrame, most: int = MOST, least: int = LEAST, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size and n of all phrases of 1 to ``most`` words with n >= ``least``; and lang, words of each language.

    ``hot`` is the number of sampled positions from which a run of leading words gets more than one group.
    """
    hot = max(1, GROUP_WORDS // SAMPLED) if hot is None else hot
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (GROUP_WORDS * WORD_BYTES)))
    sent = docs.mapInArrow(_tell(most, groups), "grp long, kind int, lang string, n long, type string, keys binary, weights binary")
    told = stage(sent.groupBy("grp").applyInArrow(_tally(least, hot), "kind int, lang string, key long, n long"))
    totals = stage(told.where(F.col("kind") == LANG).groupBy("lang").agg(F.sum("n").alias("words")))
    bitmaps = [_bitmap(told.where(F.col("kind") == kind), BITS[kind]) for kind in (WORD, PAIR)]
    common = told.where(F.col("kind") >= LEAD).select("kind", "key").collect()
    known = [np.array([r.key for r in common if r.kind == LEAD + k], np.int64).view(np.uint64) for k in range(most - 2)]
    routed = docs.mapInArrow(_send(most, groups, bitmaps, known), PACKED)
    mined = stage(routed.groupBy("grp").applyInArrow(_mine(most, least), PHRASE))
    parts = mined.where("part").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return stage(mined.where("NOT part").drop("part").unionAll(parts)), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of phrases of two words or more, at their lowest-scoring cut."""
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), cut)
    word = F.split("phrase", " ")
    cuts = cuts.withColumn("first", F.concat_ws(" ", F.slice(word, F.lit(1), F.col("k"))))
    cuts = cuts.withColumn("rest", F.concat_ws(" ", F.slice(word, F.col("k") + 1, F.col("size"))))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = lookup_join(cuts, totals.withColumnRenamed("words", "n"), ["lang"], "inner")
    wide = "decimal(38,0)"
    cuts = cuts.withColumn("score", F.expr(f"(cast(1000 AS {wide}) * a * n) div (cast(l AS {wide}) * r)"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "size")).alias("x"))
    return lowest.select("lang", "phrase", "x.size", "x.a", "x.l", "x.r", "x.n", "x.score")


def maximal(found: DataFrame, percent: int = COVERED) -> DataFrame:
    """``found`` without phrases of which a longer one holds ``percent`` per cent of the occurrences.

    Between a phrase and a longer one that holds it lies one that is a word longer and at least as frequent as the longest,
    so only phrases of one more word are looked at.
    """
    word = F.split("phrase", " ")
    inner = F.array(F.slice(word, F.lit(1), F.col("size") - 1), F.slice(word, F.lit(2), F.col("size") - 1))
    longer = found.where("size > 2").select("lang", F.explode(inner).alias("w"), "a")
    longer = longer.groupBy("lang", F.concat_ws(" ", "w").alias("phrase")).agg(F.max("a").alias("most"))
    return found.join(longer, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("most") < percent * F.col("a"), F.lit(True))
    ).drop("most")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language; a language's phrases are thinned in salted parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.withColumn("rank", F.col("rank").cast("long")).drop("salt")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, percent: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and size of the first ``top`` phrases of each language of (text, lang).

    a: occurrences of the phrase; l, r: of the parts before and after its lowest-scoring cut (of equal ones the first);
    n: words of the language; score: floor(1000 * a * n / (l * r)), computed in whole numbers of up to 38 digits.

    A null lang is ``und``. Null, empty and blank texts have no words. Repeated rows count each time. Languages without a
    candidate have no row; extra columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    phrases, totals = frequent_phrases(own, most, least)
    found = ranked(maximal(scored(phrases, totals), percent), top)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "size")
