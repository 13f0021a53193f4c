"""Mixing sources to target weights by temperature, realised as budgeted permutations of blocks.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they are), normalised.
The exponent is bisected until the weights have the target entropy, or until no source is repeated more often than the
limit. With the budget that reads every document once at least, a source of weight w and t tokens is read budget * w / t
times: in whole passes, and a rest. Each source is dealt into blocks of about equal size by a hash of the document; each
pass permutes its blocks, and the rest takes whole blocks of its permutation and then documents of the next block, in
order of their hashes, until it has its tokens: a source misses its budget by less than one document.

Tokens are fields between blanks and line ends. Results: null and empty texts have 0 tokens and go with their block; a null
source counts as the source ''; rows with a null id take part; repeated rows are documents of their own, and equal rows
are cut together. Very long texts are counted whole, and miss no budget by more than themselves. Without tokens, every row
is returned once; an empty table gives no rows. Columns that have the name of a new one (n_tokens, epoch, block, position)
are replaced, others of any name are kept. position (0 to 1) orders the mixture; rows of one source
keep their share of any stretch of it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.common import bounded_broadcast, masked, staged, table

#: Least tokens of a block, and blocks in all at most.
BLOCK_TOKENS, MOST_BLOCKS = 1 << 16, 1 << 17
#: Ranges of hashes that a source's opened block is summed up by, as a power of two.
RANGE_BITS = 12


def token_count(text: str = "text") -> Column:
    c = F.col(text)
    blanks = F.length(c) * 2 - F.length(F.replace(c, F.lit(" "), F.lit(""))) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.coalesce(F.when(F.length(c) > 0, blanks + 1), F.lit(0)).cast("long")


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    powers = [math.exp(exponent * math.log(t / total)) if t else 0.0 for t in tokens]
    return [p / math.fsum(powers) for p in powers]


def repetition(tokens: list[int], weights: list[float]) -> float:
    """How often the most repeated source is read while the least repeated one is read once."""
    rates = [w / t for w, t in zip(weights, tokens, strict=True) if t]
    return max(rates) / min(rates) if rates else 1.0


def bisected(tokens: list[int], target_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The least exponent in 0..1 that keeps the repetition limit, or the one with the target entropy (or nearest to it)."""
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give either target_entropy or max_repetition")
    if not any(tokens):
        return 1.0

    def flat(exponent: float) -> bool:
        weights = tempered(tokens, exponent)
        return entropy(weights) > target_entropy if target_entropy is not None else repetition(tokens, weights) > max_repetition

    low, high = 0.0, 1.0
    if not flat(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if flat(middle) else (low, middle)
    return high


@dataclass(frozen=True)
class Plan:
    exponent: float
    weights: dict[str, float]
    tokens: dict[str, int]
    budget: float  # tokens of the mixture


def plan(docs: DataFrame, source: str, tokens: str, target_entropy: float | None, max_repetition: float | None, budget: float | None) -> Plan:
    # a row of each source comes to the driver: sources are what a person gives weights to
    totals = docs.groupBy(source).agg(F.sum(tokens).alias("t")).orderBy(source).collect()
    names, counts = [r[0] for r in totals], [int(r["t"]) for r in totals]
    exponent = bisected(counts, target_entropy, max_repetition)
    weights = tempered(counts, exponent) if any(counts) else [0.0] * len(counts)
    if budget is None:
        budget = max((t / w for t, w in zip(counts, weights, strict=True) if w), default=0.0)
    return Plan(exponent, dict(zip(names, weights, strict=True)), dict(zip(names, counts, strict=True)), budget)


def mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None, budget: float | None = None,
        seed: int = 0, source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with n_tokens, epoch, block and position, as often as the plan has each row; columns of these names are replaced."""
    spark = docs.sparkSession
    given = [c.lower() for c in docs.columns]
    docs, back = masked(docs, [])
    source, text, key = (f"__user{given.index(c.lower())}" for c in (source, text, key))
    rows = docs.withColumn("n_tokens", token_count(text)).withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    p = plan(rows, "__source", "n_tokens", target_entropy, max_repetition, budget)
    total = sum(p.tokens.values())
    size = max(BLOCK_TOKENS, math.ceil(total / MOST_BLOCKS))
    passes = []
    for name, t in p.tokens.items():
        want = p.budget * p.weights[name]
        whole = int(want / t + 1e-9) if t else 1
        rest = max(0.0, want - whole * t) if t else 0.0
        passes.append((name, float(t), math.ceil(t / size) or 1, whole, rest if rest > 0.5 else 0.0, max(want, 1.0)))
    schema = "__source string, __t double, __blocks int, __whole int, __rest double, __want double"
    sources = bounded_broadcast(spark.createDataFrame(passes, schema), 96)
    hash_ = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    dealt = rows.join(sources, "__source").withColumn("__hash", hash_).withColumn("block", F.pmod("__hash", F.col("__blocks").cast("long")).cast("int"))

    sizes = staged(dealt.groupBy("__source", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    epochs = sizes.join(sources, "__source").withColumn("epoch", F.explode(F.expr("sequence(0, __whole)")))
    turn = Window.partitionBy("__source", "epoch").orderBy(F.xxhash64(F.lit(seed), "__source", "epoch", "block"), "block")
    # MOST_BLOCKS blocks, and one more for each source, at most
    placed = epochs.withColumn("before", F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    left = F.when(F.col("epoch") < F.col("__whole"), F.lit(float("inf"))).otherwise(F.col("__rest") - F.col("before"))
    placed = placed.withColumn("left", left).where("left > 0").select(
        F.col("__source").alias("s"), F.col("block").alias("b"), "epoch", ((F.col("epoch") * F.col("__t") + F.col("before")) / F.col("__want")).alias("position"),
        F.when(F.col("left") < F.col("tokens"), F.col("left")).alias("cut"),
    )
    turns = bounded_broadcast(staged(placed, "mix-turns"), 64, 32 << 20)

    match = lambda t: (dealt["__source"] == t["s"]) & (dealt["block"] == t["b"])
    # the one block of a source that its rest doesn't take whole: documents by hash, until the tokens are reached
    opened = dealt.join(turns.where("cut is not null"), match(turns)).select("__source", "block", "__hash", "n_tokens", "cut")
    # first the range of hashes in which they are reached, then the document in that range
    range_of = F.shiftright("__hash", 64 - RANGE_BITS)
    ranges = staged(opened.groupBy("__source", range_of.alias("range")).agg(F.sum("n_tokens").alias("tokens"), F.max("cut").alias("cut")), "mix-ranges")
    by_range = Window.partitionBy("__source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** RANGE_BITS rows for each source
    reached = (
        ranges.withColumn("before", F.coalesce(F.sum("tokens").over(by_range), F.lit(0))).where("before < cut")
        .groupBy("__source").agg(F.max(F.struct("range", "before")).alias("r")).select(F.col("__source").alias("r"), F.col("r.range").alias("range"), F.col("r.before").alias("before_range"))
    )
    by_hash = Window.partitionBy("__source").orderBy("__hash").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        opened.join(bounded_broadcast(staged(reached, "mix-reached"), 48), (F.col("__source") == F.col("r")) & (range_of == F.col("range")))
        .groupBy("__source", "__hash", "cut", "before_range").agg(F.sum("n_tokens").alias("n_tokens"))
        .withColumn("before", F.col("before_range") + F.coalesce(F.sum("n_tokens").over(by_hash), F.lit(0)))
        .where("before < cut").groupBy("__source").agg(F.max("__hash").alias("last")).select(F.col("__source").alias("e"), "last")
    )
    out = dealt.join(turns, match(turns)).join(bounded_broadcast(staged(edge, "mix-edges"), 32), F.col("__source") == F.col("e"), "left")
    out = out.where(F.col("cut").isNull() | (F.col("__hash") <= F.col("last")))
    return back(out, ["n_tokens", "epoch", "block", "position"])


#: No source is read more than so many times as often as the least repeated one.
MAX_REPETITION = 1.5


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, max_repetition=MAX_REPETITION).select("doc_id", "source", "n_tokens", "epoch", "block", "position")
