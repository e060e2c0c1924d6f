"""Information-theoretic sanitisation of personal data.

Base spans are identifiers found by patterns: e-mail addresses, IP addresses, card and phone numbers. Each identifier that
occurs is a protected entity. Other terms may reveal it: how strongly is estimated from the corpus, by pointwise mutual
information over the words around the entity, as a share of the entity's own information:

    disclosure(e, t) = log2(f(e, t) * N / (f(e) * f(t))) / log2(N / f(e))

N: words of the corpus; f(t): occurrences of the term; f(e): words in the contexts of the entity; f(e, t): occurrences of
the term in them. It is 1 for a term that occurs near the entity only, and falls with every occurrence elsewhere. Contexts
are told apart by their words, so copies of a document count once, and a term needs ``SUPPORT`` different contexts. In
documents that hold the entity, a term from ``REMOVE`` on is removed, one from ``GENERALISE`` on gives way to its kind.

Plan:
1. a pass over the texts gives the contexts; equal ones are merged, entities with too few dropped, and the rest counted by
   (entity, term);
2. a second pass counts the terms that are left, which a bitmap of fixed size marks, and all words;
3. a third pass writes the result of every document. Where bitmaps of fixed size say that a document may hold both sides
   of a revealing pair, its pairs are joined with the table of revealing pairs, and the text is met by its hash.

No table is broadcast but the bitmaps (at most 8 MiB). A term or pair that is marked by chance only costs work.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.words import GOLDEN, mix, slices
from weekloom.session import stage

KINDS = ("email", "ip", "card", "phone", "term")
TERM = 4
WIDTH, NEAR = 8, 160  # words on each side of an entity, that lie whole within so many characters
SUPPORT = 3  # different contexts of an entity that a term must occur in
GENERALISE, REMOVE = 0.75, 0.9
BITS = 23
PAIR_BITS = 26
HELD_TERMS = 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}<>*_|#-/\\"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address has its own @, so the search starts there: no run of characters is read more than once."""
    last = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = m.end()


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """In a run of numbers and dots, each four numbers in turn are one match."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all identifiers, in order of start and kind; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(a, 1, b) for a, b in _ips(text)]
        for m in DIGITS.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def entity(text: str, span: tuple[int, int, int]) -> bytes:
    """The identifier in one spelling."""
    a, kind, b = span
    value = text[a:b].lower()
    if kind > 1:
        value = NOT_DIGIT.sub("", value)
    return f"{kind}:{value}".encode()


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with blanks for the identifiers, as long as before."""
    kept, last = [], 0
    for a, _, b in spans:
        if b > last:
            kept += [text[last:a], " " * (b - max(a, last))] if a > last else [" " * (b - last)]
            last = b
    return "".join([*kept, text[last:]])


def term(word: str) -> str:
    """A word as a term: without marks at its ends, in lower case; '' if it is shorter than three characters."""
    plain = word.strip(EDGE).lower()
    return plain if len(plain) > 2 else ""


def context(plain: str, a: int, b: int) -> list[str]:
    """The terms around a span: up to ``WIDTH`` words on each side, that lie whole within ``NEAR`` characters."""
    start, stop = max(0, a - NEAR), min(len(plain), b + NEAR)
    left, right = WORD.findall(plain[start:a]), WORD.findall(plain[b:stop])
    if left and start and not plain[start - 1].isspace() and not plain[start].isspace():
        left = left[1:]
    if right and stop < len(plain) and not plain[stop].isspace() and not plain[stop - 1].isspace():
        right = right[:-1]
    return [t for t in map(term, left[-WIDTH:] + right[:WIDTH]) if t]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for part in slices(batch):
            yield part, [t or "" for t in part.column("text").to_pylist()]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each identifier: its hash, the hash of its context, and the context's terms."""
    schema = pa.schema([("entity", pa.binary()), ("seen", pa.binary()), ("terms", pa.list_(pa.string()))])
    for _, texts in _texts(batches):
        rows = []
        for text in texts:
            if spans := base_spans(text):
                plain = masked(text, spans)
                for span in spans:
                    terms = context(plain, span[0], span[2])
                    seen = xxhash.xxh3_128_digest("\n".join(terms).encode())
                    rows.append({"entity": xxhash.xxh3_128_digest(entity(text, span)), "seen": seen, "terms": terms})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _hash(x: str | bytes) -> int:
    return xxhash.xxh64_intdigest(x, 42)  # as Spark's xxhash64 of one column


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the column ``key``, hashes of 64 bits."""
    slot = F.shiftrightunsigned("key", 64 - bits) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.collect():  # at most 2**bits / 8 bytes
        own = np.frombuffer(bytes(r.bits), np.uint8)
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(own)] = own
    return out


def _marked(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _hashes(values: list) -> np.ndarray:
    return np.fromiter(map(_hash, values), np.uint64, len(values))


def _count(bitmap: np.ndarray):
    """Occurrences of the marked terms; all words of a task are counted under no term."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, wanted, totals = 0, {}, {}
        for _, texts in _texts(batches):
            for text in texts:
                if not text:
                    continue
                spans = base_spans(text)
                found = WORD.findall(masked(text, spans) if spans else text)
                words += len(found)
                if new := [w for w in dict.fromkeys(found) if w not in wanted]:
                    terms = [term(w) for w in new]
                    marks = _marked(bitmap, _hashes(terms), BITS).tolist()
                    wanted.update((w, t if m and t else "") for w, t, m in zip(new, terms, marks, strict=True))
                for w in found:
                    if t := wanted[w]:
                        totals[t] = totals.get(t, 0) + 1
            if len(wanted) > HELD_TERMS:
                wanted = {}
            if len(totals) > HELD_TERMS:
                yield pa.record_batch([list(totals), list(totals.values())], schema=schema)
                totals = {}
        yield pa.record_batch([[None, *totals], [words, *totals.values()]], schema=schema)

    return count


def revealing(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """entity (hash), term, disclosure and gone (removed, or else generalised) of all revealing pairs of (text)."""
    raw = docs.mapInArrow(_contexts, "entity binary, seen binary, terms array<string>")
    contexts = stage(raw.groupBy("entity", "seen").agg(F.first("terms").alias("terms")))
    entities = contexts.groupBy("entity").agg(F.count("*").alias("contexts"), F.sum(F.size("terms")).alias("f_e"))
    entities = entities.where(F.col("contexts") >= support).select("entity", "f_e")
    terms = contexts.join(entities, "entity").select("entity", "f_e", "seen", F.explode("terms").alias("term"))
    in_context = terms.groupBy("entity", "term", "f_e", "seen").agg(F.count("*").alias("n"))
    pairs = in_context.groupBy("entity", "term", "f_e").agg(F.sum("n").alias("f_et"), F.count("*").alias("contexts"))
    pairs = stage(pairs.where(F.col("contexts") >= support).drop("contexts"))
    if pairs.isEmpty():
        return pairs.selectExpr("entity", "term", "cast(0 AS double) AS disclosure", "false AS gone")
    bitmap = _bitmap(pairs.select("term").distinct().select(F.xxhash64("term").alias("key")), BITS)
    counted = stage(docs.mapInArrow(_count(bitmap), "term string, n long").groupBy("term").agg(F.sum("n").alias("f_t")))
    words = float(counted.where("term IS NULL").first().f_t)
    known = pairs.join(counted.where("term IS NOT NULL"), "term")
    # An entity whose contexts are the whole corpus has no information that a term could give away.
    own = F.log2(F.lit(words) / F.col("f_e"))
    shared = F.log2(F.col("f_et") * F.lit(words) / (F.col("f_e").cast("double") * F.col("f_t")))
    known = known.withColumn("disclosure", F.when(own > 0, shared / own).otherwise(F.lit(0.0)))
    known = known.where(F.col("disclosure") >= generalise)
    return stage(known.select("entity", "term", "disclosure", (F.col("disclosure") >= remove).alias("gone")))


def general(word: str) -> str:
    """What stands for a generalised term: its kind."""
    return "<NUMBER>" if any(c.isdigit() for c in word) else "<NAME>" if word[:1].isupper() else "<TERM>"


def rewritten(text: str, spans: list[tuple[int, int, int]], gone: set[str]) -> str:
    """The text with the kind for each identifier and generalised term, without the removed terms."""
    kept, last = [], 0
    for a, kind, b in spans:
        if b <= last:
            continue  # inside an earlier span
        kept.append(text[last : max(a, last)])
        if a >= last:
            own = text[a:b]
            kept.append(f"<{KINDS[kind].upper()}>" if kind != TERM else "" if own.lower() in gone else general(own))
        last = b
    return "".join([*kept, text[last:]])


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, text string"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("text", pa.string())]
)
ASKED = "array<struct<entity:binary,term:string>>"
ASKED_TYPE = pa.list_(pa.struct([("entity", pa.binary()), ("term", pa.string())]))


def _base(maps: tuple[np.ndarray, ...] | None, texts_too: bool):
    """The result of each text from its base spans; ``asked`` has the pairs that may reveal an entity of the text."""
    schema = SCHEMA.append(pa.field("key", pa.binary())).append(pa.field("asked", ASKED_TYPE))

    def pairs(text: str, spans: list[tuple[int, int, int]]) -> list[dict] | None:
        entities = list(dict.fromkeys(xxhash.xxh3_128_digest(entity(text, s)) for s in spans))
        h = _hashes(entities)
        likely = np.nonzero(_marked(maps[0], h, BITS))[0]
        if not len(likely):
            return None
        terms = [t for t in dict.fromkeys(map(term, WORD.findall(masked(text, spans)))) if t]
        t = _hashes(terms)
        near = np.nonzero(_marked(maps[1], t, BITS))[0]
        out = []
        for e in likely:
            both = near[_marked(maps[2], mix(h[e] * GOLDEN + t[near]), PAIR_BITS)]
            out += [{"entity": entities[e], "term": terms[k]} for k in both]
        return out or None

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            rows: dict[str, list] = {name: [] for name in schema.names}
            rows["doc_id"] = part.column("doc_id")
            for text in texts:
                spans = base_spans(text)
                asked = pairs(text, spans) if spans and maps else None
                for kind in range(4):
                    rows[f"n_{KINDS[kind]}"].append(sum(s[1] == kind for s in spans))
                rows["spans"].append(listed(spans))
                rows["base_sha256"].append(hashlib.sha256(rows["spans"][-1].encode()).hexdigest())
                rows["text"].append(text if asked else rewritten(text, spans, set()) if texts_too else None)
                rows["key"].append(xxhash.xxh3_128_digest(text.encode()) if asked else None)
                rows["asked"].append(asked)
            yield pa.record_batch([pa.array(rows[f.name], f.type) if f.name != "doc_id" else rows["doc_id"] for f in schema], schema=schema)

    return base


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the spans of the revealing terms (term, gone) of each text."""
    for part, texts in _texts(batches):
        spans_out, texts_out = [], []
        for text, found in zip(texts, part.column("found").to_pylist(), strict=True):
            spans = base_spans(text)
            gone = {x["term"] for x in found or () if x["gone"]}
            terms = {x["term"] for x in found or ()}
            if terms:
                for m in WORD.finditer(masked(text, spans)):
                    if (t := term(m.group())) in terms:
                        a = m.start() + len(m.group()) - len(m.group().lstrip(EDGE))
                        spans.append((a, TERM, m.end() - len(m.group()) + len(m.group().rstrip(EDGE))))
            spans.sort()
            spans_out.append(listed(spans))
            texts_out.append(rewritten(text, spans, gone))
        columns = [part.column(f.name) for f in SCHEMA][:-2]
        yield pa.record_batch([*columns, pa.array(spans_out, pa.string()), pa.array(texts_out, pa.string())], schema=SCHEMA)


def sanitised(
    docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, texts: bool = True
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and the sanitised text of every row of (doc_id, text).

    spans lists kind:start:end of the identifiers and of the revealing terms (``term``), by start and then kind;
    base_sha256 is the hash of that list without the terms. Offsets are code points, ends exclusive.

    Null and empty texts have no spans and an empty text. Results depend on a row's text and on the corpus, never on
    doc_id: repeated rows and null or shared doc_ids get each their own row. Extra columns are ignored; an empty table
    gives no rows. Without ``texts`` the column text is left out.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = revealing(own.select("text"), generalise, remove, support)
    columns = [c.split()[0] for c in OUT.split(", ")][: None if texts else -1]
    first = f"{OUT}, key binary, asked {ASKED}"
    if known.isEmpty():
        return own.mapInArrow(_base(None, texts), first).select(*columns)
    # the hash of a pair as in _base, whose numbers wrap around 64 bits
    pair = known.select("entity", "term").mapInArrow(_pair_keys, "key long")
    maps = (
        _bitmap(known.select(F.xxhash64("entity").alias("key")), BITS),
        _bitmap(known.select(F.xxhash64("term").alias("key")), BITS),
        _bitmap(pair, PAIR_BITS),
    )
    found = stage(own.mapInArrow(_base(maps, texts), first))
    asked = found.where("asked IS NOT NULL")
    wanted = asked.select("key", F.explode("asked").alias("x")).select("key", "x.entity", "x.term").distinct()
    told = wanted.join(known.select("entity", "term", "gone"), ["entity", "term"]).groupBy("key", "term").agg(F.max("gone").alias("gone"))
    told = told.groupBy("key").agg(F.collect_list(F.struct("term", "gone")).alias("found"))  # at most the terms of a text
    more = asked.join(told, "key", "left").select(*[c.split()[0] for c in OUT.split(", ")], "found")
    return found.where("asked IS NULL").select(*columns).unionAll(more.mapInArrow(_with_terms, OUT).select(*columns))


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        e, t = (_hashes(batch.column(c).to_pylist()) for c in ("entity", "term"))
        yield pa.record_batch([pa.array(mix(e * GOLDEN + t).view(np.int64))], ["key"])
