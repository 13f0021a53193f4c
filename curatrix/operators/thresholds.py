"""Threshold search: sorted running sums and grids of counts instead of a pass for each threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.labels import CLASSES
from curatrix.functions.scores import safe_div
from curatrix.operators.metrics import score_steps

F1_GRID = [round(0.05 * k, 6) for k in range(1, 20)]
# The thresholds tried in order.
FPR_LIST = [0.90, 0.92, 0.94, 0.95, 0.96, 0.98, 0.985, 0.99, 0.995]
PAIR_GRID = [0.5 + 0.01 * k for k in range(51)]


def fpr_candidates(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """(keys, threshold, tp, fp, pos, neg): each distinct score and 1.0 as a threshold."""
    steps = score_steps(rows, keys, score, positive).select(*keys, F.col(score).alias("threshold"), "tp", (F.col("k") - F.col("tp")).alias("fp"))
    totals = rows.groupBy(*keys).agg(F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg"))
    ones = totals.select(*keys, F.lit(1.0).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    both = steps.unionByName(ones)
    return both.join(F.broadcast(totals), keys) if keys else both.crossJoin(F.broadcast(totals))  # a row for each key


def tune_fpr(rows: DataFrame, keys: list[str], score: str, positive: Column, target: Column) -> DataFrame:
    """(keys, threshold, fpr, recall, precision): the most recall within the target, then the largest threshold. None: 1.0 and fpr 1."""
    found = fpr_candidates(rows, keys, score, positive).withColumn("fpr", safe_div(F.col("fp"), F.col("neg")))
    best = F.max(F.when(F.col("fpr") <= target, F.struct("tp", "threshold", "fp", "fpr", "pos")))
    out = found.groupBy(*keys).agg(best.alias("b"))
    none = F.col("b").isNull()
    return out.select(
        *keys, F.when(none, 1.0).otherwise(F.col("b.threshold")).alias("threshold"), F.when(none, 1.0).otherwise(F.col("b.fpr")).alias("fpr"),
        F.when(none, 0.0).otherwise(safe_div(F.col("b.tp"), F.col("b.pos"))).alias("recall"), F.when(none, 0.0).otherwise(safe_div(F.col("b.tp"), F.col("b.tp") + F.col("b.fp"))).alias("precision"),
    )


def grid_counts(rows: DataFrame, keys: list[str], score: str, positive: Column, grid: list[float]) -> DataFrame:
    """(keys, threshold, tp, fp, pos, neg) of every threshold of a short grid, in one pass."""
    sums = [F.struct(F.lit(g).alias("threshold"), F.count_if(positive & (F.col(score) >= g)).alias("tp"), F.count_if(~positive & (F.col(score) >= g)).alias("fp")) for g in grid]
    out = rows.groupBy(*keys).agg(F.array(*sums).alias("s"), F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    return out.select(*keys, F.explode("s").alias("s"), "pos", "neg").select(*keys, "s.*", "pos", "neg")


def tune_f1(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """(keys, threshold, f1): the first threshold of the grid with the greatest F1."""
    f1 = safe_div(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos"))
    found = grid_counts(rows, keys, score, positive, F1_GRID).withColumn("f1", f1)
    best = found.groupBy(*keys).agg(F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select(*keys, (-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def tune_lowest(rows: DataFrame, keys: list[str], score: str, positive: Column, target: float = 0.05) -> DataFrame:
    """(keys, threshold, fpr): the lowest of the list within the target; null if none is."""
    found = grid_counts(rows, keys, score, positive, FPR_LIST).withColumn("fpr", safe_div(F.col("fp"), F.col("neg")))
    best = found.groupBy(*keys).agg(F.min(F.when(F.col("fpr") <= target, F.struct("threshold", "fpr"))).alias("b"))
    return best.select(*keys, F.col("b.threshold").alias("threshold"), F.col("b.fpr").alias("fpr"))


def tune_pair_grid(rows: DataFrame, scam: str, topic: str, gold: str, target: float) -> DataFrame:
    """(scam_threshold, topic_threshold, recall, precision, macro_f1, note) of the best pair of thresholds of 51 by 51.

    Rows are counted by gold and by how many grid values their two scores reach, so the search runs over a table of counts.
    """
    spark = rows.sparkSession
    reached = lambda c: reduce(lambda a, b: a + b, [(F.col(c) >= g).cast("int") for g in PAIR_GRID])
    cells = rows.groupBy(F.col(gold).alias("gold"), reached(scam).alias("i"), reached(topic).alias("j")).agg(F.count("*").alias("c"))
    size = len(PAIR_GRID)
    frame = spark.createDataFrame([(g,) for g in CLASSES], "gold string").crossJoin(spark.range(size + 1).select(F.col("id").cast("int").alias("i"))).crossJoin(spark.range(size + 1).select(F.col("id").cast("int").alias("j")))
    full = frame.join(cells, ["gold", "i", "j"], "left").na.fill(0)  # 3 * 52 * 52 rows
    upto = Window.partitionBy("gold", "j").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("gold", "i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    sums = full.withColumn("below", F.sum("c").over(upto)).withColumn("topic_hits", F.sum("below").over(onward)).withColumn("all_below", F.sum("below").over(Window.partitionBy("gold", "i")))
    totals = Window.partitionBy("gold")
    sums = sums.withColumn("total", F.sum("c").over(totals))
    # thresholds number a and b: cells below a are those up to i = a; topic from j = b + 1 on
    at = sums.where(f"i < {size} and j > 0").select("gold", F.col("i").alias("a"), (F.col("j") - 1).alias("b"), (F.col("total") - F.col("all_below")).alias("scam"), F.col("topic_hits").alias("topic"), (F.col("all_below") - F.col("topic_hits")).alias("clean"), "total")
    of = lambda g, c: F.sum(F.when(F.col("gold") == g, F.col(c)).otherwise(0))
    predicted = {"clean": "clean", "topic_crypto": "topic", "scam": "scam"}
    f1 = [safe_div(2 * of(g, c), of(g, "total") + F.sum(c)) for g, c in predicted.items()]
    tried = at.groupBy("a", "b").agg(
        safe_div(of("scam", "scam"), of("scam", "total")).alias("recall"), safe_div(of("scam", "scam"), F.sum("scam")).alias("precision"),
        safe_div(F.sum("scam") - of("scam", "scam"), F.sum("total") - of("scam", "total")).alias("fpr"), ((f1[0] + f1[1] + f1[2]) / 3).alias("macro_f1"),
    )
    rank = F.struct("recall", "precision", F.round("macro_f1", 12).alias("m"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))
    best = tried.agg(F.max(F.when(F.col("fpr") <= target, rank)).alias("s"))
    grid = F.array(*[F.lit(g) for g in PAIR_GRID])
    none = F.col("s").isNull()
    return best.select(
        F.when(none, 0.99).otherwise(F.get(grid, -F.col("s.a"))).alias("scam_threshold"), F.when(none, 0.99).otherwise(F.get(grid, -F.col("s.b"))).alias("topic_threshold"),
        F.col("s.recall").alias("recall"), F.col("s.precision").alias("precision"), F.col("s.m").alias("macro_f1"), F.when(none, "no pair within the target").otherwise("").alias("note"),
    )


def bakeoff_rank(candidates: DataFrame, kind: str = "model_type") -> DataFrame:
    """Appends place and place_in_kind: by scam FPR, then recall, micro F1 and macro F1."""
    order = [F.asc("scam_fpr"), F.desc("scam_recall"), F.desc("micro_f1"), F.desc("macro_f1"), F.asc("name")]
    # a row for each candidate model: a bounded table
    return candidates.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("place_in_kind", F.row_number().over(Window.partitionBy(kind).orderBy(*order)))
