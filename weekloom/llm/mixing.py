"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at ``MOST`` times its
source's size and the excess goes to the others by weight until none is above. Every document of a source gets the whole
copies that its target allows for certain. The rest is sampled: a document's inclusion chance falls with the root of its
size, its rank is the odds of a random number, drawn by hash, over the odds of inclusion, and the lowest ranks are taken
up to the words still wanted. One more document, the one nearest in size, fills what the last whole document left open.

The source's cut is found without sorting a source: ranks are counted in a fixed number of bins, bins are added up, and
only the bin that holds the cut is ordered. What goes back to the documents is one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.operators.lookup import running_total
from weekloom.session import stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BINS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
UNITS = float(1 << 52)
SENT_ROWS, SENT_BYTES = 50_000, 8 << 20  # a table with a row per source is broadcast up to this size
SALTS = 64
MADE = ("size", "source_size", "target", "copies", "taken")
WORKING = ("key", "base", "rank", "wanted", "roots", "cut", "open", "filler", "of", "salt", "of_salt")  # names used on the way


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, roots and target of each source."""
    ranked = sizes.withColumn("no_source", F.col("source").isNull())
    ranked = running_total(ranked, [], ["no_source", "source"], F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__before") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.select("source", "source_size", "roots", weight.alias("weight")))
    cap = most * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # each round stops more sources at their cap, until none is above
        above = F.lit(level) * F.col("weight") >= cap if capped >= 0 else F.lit(False)
        got = ranked.agg(
            F.sum(F.when(above, cap)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")
        ).first()
        if got.n == capped or not got.open:
            break
        level, capped = (total - (got.full or 0)) / got.open, got.n
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))


def _by_source(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """Joins a stored table with a row per source, in column ``of``, to rows with source and key.

    Its size is counted first; beyond the bound it is repeated per salt, so that a hot source is spread over many tasks.
    """
    n, size = small.agg(F.count("*"), F.sum(F.octet_length("of"))).first()
    match = F.col("source").eqNullSafe(F.col("of"))
    if n <= SENT_ROWS and (size or 0) <= SENT_BYTES:
        return rows.join(F.broadcast(small), match, how).drop("of")
    rows = rows.withColumn("salt", F.pmod(F.col("key"), F.lit(SALTS)))
    small = small.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(small, match & (F.col("salt") == F.col("of_salt")), how).drop("of", "salt", "of_salt")


def _ranked(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents with base (whole copies) and rank (0 to 1, null where nothing is to be sampled)."""
    rows = _by_source(docs, sources.withColumnRenamed("source", "of"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("base", F.floor(ratio + 1e-12))
    share = F.greatest(ratio - F.col("base"), F.lit(0.0))
    chance = share * F.col("source_size") / F.col("roots") / F.sqrt("size")
    chance = F.least(F.greatest(chance, F.lit(1e-9)), F.lit(1 - 1e-9))
    drawn = (F.pmod(F.col("key"), F.lit(1 << 52)) + 0.5) / F.lit(UNITS)
    q = drawn / (1 - drawn) * (1 - chance) / chance
    rank = F.when((F.col("size") > 0) & (share > 1e-9), q / (1 + q))
    return rows.withColumn("rank", rank).withColumn("wanted", F.col("target") - F.col("base") * F.col("source_size"))


def sized(docs: DataFrame) -> DataFrame:
    """The documents with size and the key that random numbers are drawn from."""
    return docs.withColumn("size", n_words()).withColumn("key", F.xxhash64("doc_id", "text", F.lit("mix")))


def plan(thin: DataFrame) -> DataFrame:
    """One row per source of (doc_id, source, size, key): source_size, roots, target, cut and filler."""
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.sqrt("size")).alias("roots"))
    sources = stage(targets(sizes))
    rows = _ranked(thin, sources).where("rank IS NOT NULL")
    rows = rows.withColumn("bin", F.floor(F.col("rank") * BINS))
    counted = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("wanted").alias("wanted"))
    by_bin = Window.partitionBy("source").orderBy("bin")  # a fixed number of rows for each source
    counted = counted.withColumn("upto", F.sum("words").over(by_bin))
    crossing = counted.where((F.col("upto") > F.col("wanted")) & (F.col("upto") - F.col("words") <= F.col("wanted")))
    crossing = stage(
        crossing.select(F.col("source").alias("of"), F.col("bin").alias("at"), (F.col("upto") - F.col("words")).alias("before"))
    )
    here = _by_source(rows, crossing).where("bin = at")
    here = here.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("rank")))
    cuts = here.where("upto <= wanted").groupBy("source").agg(F.max("rank").alias("inside"), F.max("upto").alias("sampled"))
    cuts = crossing.join(cuts.withColumnRenamed("source", "of2"), F.col("of").eqNullSafe(F.col("of2")), "left").select(
        "of",
        F.coalesce("inside", F.col("at") / BINS).alias("cut"),
        F.coalesce("sampled", "before").alias("sampled"),
        F.col("inside").isNull().alias("open"),
    )
    cuts = stage(cuts)
    left = _by_source(rows, cuts).where(~_within())
    gap = F.col("wanted") - F.col("sampled")
    left = left.where(F.abs(F.col("size") - gap) < gap)
    filler = left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - gap), F.col("rank"), F.col("key"))).alias("f"))
    filler = filler.select(F.col("source").alias("of3"), F.col("f.key").alias("filler"))
    both = cuts.join(filler, F.col("of").eqNullSafe(F.col("of3")), "left").drop("of3", "sampled")
    return stage(sources.join(both, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "weight"))


def _within() -> Column:
    """Below the cut; without a row inside the crossing bin the cut itself is not taken. No cut: all are."""
    return F.when(F.col("cut").isNull(), F.lit(True)).otherwise(
        F.when(F.col("open"), F.col("rank") < F.col("cut")).otherwise(F.col("rank") <= F.col("cut"))
    )


def mixed(docs: DataFrame) -> DataFrame:
    """All columns of (doc_id, text, source, ...) with size, source_size, target, copies and taken.

    size counts the words of the text (null: 0); taken = copies * size is at most 3 times the size. The words taken of a
    source come to its target up to less than its smallest fitting document. A null source is a source of its own, last
    in order; empty texts weigh nothing and get the whole copies. Rows that repeat both doc_id and text draw the same
    number and are taken together. Draws depend on doc_id and text alone, so reruns agree. Extra columns pass,
    whatever their names; only input columns with the names of the results are replaced. An empty table gives no rows.
    """
    columns = [c for c in docs.columns if c.lower() not in MADE]
    # Columns with names used on the way are put aside under private ones.
    private = {c: f"__own_{i}" if c.lower() in WORKING else c for i, c in enumerate(columns)}
    docs = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in private.items()))
    own = sized(docs)
    thin = stage(own.select("doc_id", "source", "size", "key"))
    rows = _ranked(own, plan(thin))
    extra = F.when(F.col("rank").isNull(), 0).when(_within() | (F.col("key") == F.col("filler")), 1).otherwise(0)
    copies = F.least(F.col("base") + F.coalesce(extra, F.lit(0)), F.lit(MOST)).cast("int")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select(*(F.col(f"`{name}`").alias(c) for c, name in private.items()), *MADE)
