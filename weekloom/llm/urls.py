"""URL filters: rules first, then the ratio of two character language models, in DataFrame functions only.

The urls that a rule allows and those that a rule blocks each train a variable-order Markov model over the characters of
host and path. A context's estimate is smoothed with that of the next shorter one by the number of different characters
seen after it, down to single characters and a uniform floor. A url's score is the sum of its log-likelihood differences
over its length; the threshold is where the two kinds of rule-judged urls are told apart best.

Equal urls are counted once. Everything the models gather is a table of character runs with counts, which grows with the
corpus and stays distributed; urls meet it by a join on the run. Addresses, their runs and their scores are never broadcast:
their files are far smaller than their rows, so that Spark takes them for small tables.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.operators.lookup import LOOKUP_ROWS
from weekloom.session import stage

# (action, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER = 4  # characters of the longest run: three of context and one predicted
FLOOR = 1.0 / 256
START, END = "\x02", "\x03"
MICRO = 1_000_000  # scores are added as whole millionths, so that sums don't depend on their order
BINS = 200  # of the score, for each unit


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and its action (null where no rule fits); the longest rule wins."""
    host, path = parts(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        action = F.when(fits, F.lit(verdict)).otherwise(action)
    return rows.withColumn("rule", rule).withColumn("action", action)


def _runs(addresses: DataFrame, order: int) -> DataFrame:
    """One row per character of host and path, and one for the end: the run of ``order`` characters that ends there."""
    padded = F.concat(F.lit(START * (order - 1)), F.col("address"), F.lit(END))
    runs = F.transform(F.sequence(F.lit(1), F.length("address") + 1), lambda i: F.substring(padded, i, F.lit(order)))
    return addresses.withColumn("run", F.explode(runs))


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left")


def model(addresses: DataFrame, order: int = ORDER) -> DataFrame:
    """(run, micro): log-likelihood difference, allowed minus blocked, of the last character of every run, in millionths."""
    counts = _runs(addresses, order).groupBy("run").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    counts = stage(counts)
    table = counts.select("run")
    zero = F.lit(0)
    estimate = {"a": F.lit(FLOOR), "b": F.lit(FLOOR)}
    for k in range(1, order + 1):
        tail = F.expr(f"right(run, {k})")
        grams = counts.groupBy(tail.alias(f"g{k}")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = F.expr(f"left(g{k}, {k - 1})")
        contexts = grams.groupBy(context.alias(f"c{k}")).agg(
            F.sum("a").alias(f"na{k}"),
            F.sum("b").alias(f"nb{k}"),
            F.count(F.when(F.col("a") > 0, 1)).alias(f"ta{k}"),
            F.count(F.when(F.col("b") > 0, 1)).alias(f"tb{k}"),
        )
        grams = grams.withColumnRenamed("a", f"a{k}").withColumnRenamed("b", f"b{k}")
        if k == order:
            grams = grams.withColumnRenamed(f"g{k}", "run")
            table = _joined(table, grams, "run")
        else:
            table = _joined(table.withColumn(f"g{k}", tail), grams, f"g{k}")
        table = _joined(table.withColumn(f"c{k}", F.expr(f"left(right(run, {k}), {k - 1})")), contexts, f"c{k}")
    for k in range(1, order + 1):
        for side in "ab":
            n, t, own = F.col(f"n{side}{k}"), F.col(f"t{side}{k}"), F.coalesce(F.col(f"{side}{k}"), zero)
            better = (own + t * estimate[side]) / (n + t)
            estimate[side] = F.when(n + t > 0, better).otherwise(estimate[side])
    micro = F.round((F.log(estimate["a"]) - F.log(estimate["b"])) * MICRO).cast("long")
    return table.select("run", micro.alias("micro"))


def scored(addresses: DataFrame, order: int = ORDER, limit: int = LOOKUP_ROWS) -> DataFrame:
    """The distinct addresses with score, the mean difference for each character.

    The model is broadcast if it has at most ``limit`` runs as counted, and meets the addresses by a merge join beyond that.
    """
    found = stage(model(addresses, order))
    found = F.broadcast(found) if found.count() <= limit else found.hint("merge")
    sums = _runs(addresses, order).join(found, "run").groupBy(*addresses.columns)
    sums = sums.agg(F.sum("micro").alias("sum"), F.count("*").alias("n"))
    return sums.withColumn("score", F.col("sum") / F.col("n") / MICRO)


def threshold(scores: DataFrame) -> float:
    """The score from which on urls are allowed: the least mean share of wrongly judged ones of either kind, the lowest such."""
    rows = scores.where("allowed + blocked > 0").withColumn("bin", F.floor(F.greatest(F.lit(-20.0), F.least(F.col("score"), F.lit(20.0))) * BINS))
    bins = rows.groupBy("bin").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).orderBy("bin").collect()  # 8,001 at most
    allowed, blocked = sum(r.a for r in bins), sum(r.b for r in bins)
    if not allowed or not blocked:
        return 0.0
    best, at, lost, passed = None, 0.0, 0, blocked
    for r in bins:  # cut below this bin
        wrong = lost / allowed + passed / blocked
        if best is None or wrong < best:
            best, at = wrong, r.bin / BINS
        lost, passed = lost + r.a, passed - r.b
    return at


def filtered(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of (page_id, url).

    A null url, or one without ://, has empty host and path, fits no rule and is judged by the model like any other.
    Without rule-judged urls of both kinds the difference of the models decides from 0 on; without any, all are allowed.
    Repeated rows get equal verdicts; null page_ids stay. Extra columns are ignored; an empty table gives no rows.
    """
    rows = ruled(pages.select("page_id", F.col("url").cast("string").alias("url")), rules)
    rows = rows.withColumn("address", F.concat("host", "path"))
    one = lambda verdict: F.count(F.when(F.col("action") == verdict, 1))
    addresses = stage(rows.groupBy("address").agg(one("allow").alias("allowed"), one("block").alias("blocked")))
    scores = stage(scored(addresses, order))
    least = threshold(scores)
    judged = rows.join(scores.select("address", "score").hint("merge"), "address")
    by_model = F.when(F.col("score") >= least, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", by_model).alias("verdict"), "score")
