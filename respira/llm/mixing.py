"""Temperature mixing of sources to target weights, realised as budgeted block permutations; DataFrame functions only.

Sources get weights proportional to their token share to the power of an exponent in [0, 1]. The exponent is bisected:
the largest one whose weights have the target entropy (a share of the entropy of equal weights), but no smaller than the
repetition limit allows (how often the most repeated source may be passed for one pass over the least repeated one).
Budgets in tokens follow from the weights: the least repeated source is passed exactly once, so every document is in the
mix at least once, and other sources are passed again, each pass in a new pseudo-random order, the last one as far as
the budget goes. A source's stream is cut into as many blocks as every other's, so each block holds all sources at their
weights; rows inside a block are in a pseudo-random order again.

A source's order is summed up in ranges of its hash of bounded size (totals per range, then inside each range), so that
a source with a third of all rows is spread like any other.

A document's size is its number of words, 1 at least. Nulls: a null source is a source of its own, a null text has size
1, a null doc_id is an id of its own. Rows that repeat a doc_id within a source are one unit: they are repeated
together. Ties in the hash are broken by doc_id. An empty table gives an empty mix. Columns beside doc_id, source and
text play no part.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respira.llm.common import lookup, saved

TARGET_ENTROPY = 0.95
MAX_REPEATS = 1.5
BLOCK_TOKENS = 1_000_000
RANGE_ROWS = 4096
SEED = 7
#: Halvings of the exponent's interval in all, and in one aggregate.
STEPS, BITS = 24, 6
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """One row per unit: doc_id, source, n_tokens."""
    words = F.greatest(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("n_tokens"))
    return units.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))


def source_totals(units: DataFrame) -> DataFrame:
    return units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_units"))


def exponent(totals: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The bisected exponent, rounded up to six digits; six halvings are one aggregate over the table of sources."""
    whole = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("tokens").alias("lo"), F.max("tokens").alias("hi")).first()
    if not whole.t or whole.n == 1:
        return 1.0
    log_share = F.log(F.col("tokens") / F.lit(float(whole.t)))

    target = target_entropy * math.log(whole.n)

    def enough(exponents: list[float]) -> int:
        """How many of the exponents, smallest first, keep the entropy: one aggregate over the sources for all of them."""
        each = totals.select(log_share.alias("l"), F.posexplode(F.array(*map(F.lit, exponents))).alias("i", "a"))
        # with w = e^(a*l) / z: -sum(w log w) = log z - a * sum(l e^(a*l)) / z
        sums = each.groupBy("i", "a").agg(F.sum(F.exp(F.col("a") * F.col("l"))).alias("z"), F.sum(F.col("l") * F.exp(F.col("a") * F.col("l"))).alias("y"))
        good = {r.i for r in sums.collect() if math.log(r.z) - r.a * r.y / r.z >= target}
        return next((i for i in range(len(exponents)) if i not in good), len(exponents))

    # entropy falls as the exponent grows: each aggregate halves the interval BITS times
    lo, width = 0.0, 1.0
    if enough([1.0]):
        lo = 1.0
    else:
        for _ in range(STEPS // BITS):
            width /= 1 << BITS
            lo += width * enough([lo + width * i for i in range(1, 1 << BITS)])
    # a source of share p is passed p^(a-1) times as often as one of share 1: the limit holds from here on
    spread = math.log(whole.hi / whole.lo)
    least = 1 - math.log(max_repeats) / spread if spread > math.log(max_repeats) else 0.0
    return math.ceil(max(lo, least) * 1e6) / 1e6


def _hash(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed).cast("string"), *(F.coalesce(c.cast("string"), F.lit("?")) for c in cols)))


def mix(units: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per copy of a unit in the mix: doc_id, source, n_tokens, epoch, block, position (in its block).

    `units` are the rows of sizes() and must be a written table: it is read more than once.
    """
    totals = saved(source_totals(units))
    a = exponent(totals, target_entropy, max_repeats)
    most = totals.agg(F.max("tokens").alias("hi"), F.sum("n_units").alias("n")).first()
    hi = float(most.hi or 1)
    # passes of a source, where the largest one is passed once
    budget = F.floor(F.col("tokens") * F.pow(F.col("tokens") / F.lit(hi), F.lit(a - 1.0)) + F.lit(0.5)).cast("long")
    plan = saved(totals.withColumn("budget", budget).withColumn("ranges", F.ceil(F.col("n_units") / F.lit(float(RANGE_ROWS))).cast("long")))
    total = plan.agg(F.sum("budget").alias("b")).first().b or 0
    blocks = max(1, -(-total // block_tokens))

    passes = F.ceil(F.col("budget") / F.col("tokens")).cast("int")
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("k")  # null is a source too
    of_source = lookup(units.select("*", named), saved(plan.select(named, "tokens", "budget", "ranges")), "k")
    copies = of_source.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1))).withColumn("h", _hash(seed, F.col("epoch"), F.col("doc_id")))
    unit_hash = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    copies = saved(copies.withColumn("r", F.floor(unit_hash * F.col("ranges") / F.lit(float(1 << 32))).cast("long")))

    key = ["k", "epoch", "r"]
    sums = copies.groupBy(*key).agg(F.sum("n_tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("k", "epoch").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = lookup(copies, saved(sums.select(*key, before.alias("range_start"))), key)
    inside = Window.partitionBy(*key).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("epoch") * F.col("tokens") + F.col("range_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    placed = joined.withColumn("at", at).filter(F.col("at") + F.col("n_tokens") <= F.col("budget"))
    block = F.floor(F.col("at") * F.lit(float(blocks)) / F.col("budget")).cast("long")
    in_block = Window.partitionBy("block").orderBy(_hash(seed, F.lit("block"), F.col("source"), F.col("epoch"), F.col("doc_id")), "doc_id", "source", "epoch")
    return placed.select("doc_id", "source", "n_tokens", "epoch", block.alias("block")).withColumn("position", F.row_number().over(in_block).cast("long"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    return mix(saved(sizes(docs)), **options)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs, each as often as the mix has it; the columns stay."""
    own = [f"{c}_{uuid.uuid4().hex}" for c in ("id", "source")]
    copies = mix_documents(docs, **options).select(F.col("doc_id").alias(own[0]), F.col("source").alias(own[1]))
    return docs.join(copies, F.col("doc_id").cast("long").eqNullSafe(F.col(own[0])) & F.col("source").cast("string").eqNullSafe(F.col(own[1]))).drop(*own)
