"""Samples for training whose shares of clean rows, hard negatives and common labels lie within bands, balanced by occurrences of labels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.plans.ranking import hash_key, running_sums
from curatrix.sources.files import staged

#: Rounds of fitting at most; it ends before once no label is above its cap by more than this share.
ROUNDS, SLACK = 60, 1e-3
#: A weight of 1, as a whole number: sums of weights don't depend on the order of adding.
ONE = 10**9


@dataclass(frozen=True)
class Bands:
    """Clean rows' share of all, hard negatives' share of clean ones (None: as they come), and the largest share of all of one label."""

    clean: tuple[float, float] = (0.70, 0.85)
    hard: tuple[float, float] | None = (0.20, 0.40)
    head: float = 0.10


#: The mix of rows that thresholds are set on.
EVALUATION = Bands((0.90, 0.98), None, 1.0)


def positives(labels: str) -> Column:
    """The labels of a row that are not clean, once each and sorted; null labels are none."""
    return F.array_sort(F.array_except(F.array_compact(F.coalesce(labels, F.array().cast("array<string>"))), F.array(F.lit("clean"))))


def sizes(positive: float, hard: int, easy: int, bands: Bands) -> tuple[int, int, int]:
    """(positive, hard, easy): the largest sample from so many rows within the bands, in whole rows. Where there are no positives, no
    clean rows or no hard negatives, the bands that need them don't hold, and the others do."""
    low, high = bands.clean
    most = hard + easy
    if bands.hard and hard and easy:
        most = min(most, math.floor(hard / bands.hard[0] + 1e-9), math.floor(easy / (1 - bands.hard[1]) + 1e-9))
    kept = math.floor(positive + 1e-9)
    clean = min(most, math.floor(kept * high / (1 - high) + 1e-9)) if kept and high < 1 else most
    if clean:
        kept = min(kept, math.floor(clean * (1 - low) / low + 1e-9))
    take = round(clean * hard / (hard + easy)) if clean else 0
    if bands.hard and hard and easy:
        take = min(max(take, math.ceil(clean * bands.hard[0] - 1e-9)), math.floor(clean * bands.hard[1] + 1e-9))
    take = min(max(take, clean - easy), hard)
    return kept, take, clean - take


def label_weights(sets: DataFrame, hard: int, easy: int, bands: Bands) -> dict[str, float]:
    """The weight of each label for sets (positive, n): a row's weight is the largest of its labels', so a rare label keeps its rows.

    Proportional fitting: labels above their cap have their weights lowered by as much, again and again, since rows that other labels
    keep count as well. A label whose other labels alone keep it above the cap ends near 0. A round is one aggregation over label sets;
    the driver holds a number for each label.
    """
    weights: dict[str, float] = {}
    for _ in range(ROUNDS):
        least = row_weight(weights)
        total = sets.agg(F.sum(F.col("n") * least)).first()[0] or 0.0
        size = sizes(total, hard, easy, bands)
        scale = size[0] / total if total else 1.0
        kept = sets.select("n", least.alias("w"), F.explode("positive").alias("label")).groupBy("label").agg(F.sum(F.col("n") * F.col("w")).alias("kept"), F.sum("n").alias("n")).collect()
        cap = bands.head * sum(size)
        above = {r["label"]: r["kept"] * scale / cap for r in kept if cap and r["kept"] * scale > cap * (1 + SLACK) and weights.get(r["label"], 1.0) > 1e-9}
        if not above:
            break
        for label, times in above.items():
            weights[label] = max(1e-9, weights.get(label, 1.0) / times)
    return weights


def row_weight(weights: dict[str, float], positive: str = "positive") -> Column:
    """The largest weight of a row's labels; labels that have none weigh 1."""
    if not weights:
        return F.lit(1.0)
    told = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    return F.array_max(F.transform(positive, lambda x: F.coalesce(told[x], F.lit(1.0))))


def balanced_sample(rows: DataFrame, labels: str, hard: Column, key: str, bands: Bands = Bands(), seed: int = 42) -> DataFrame:
    """Appends kind (positive, hard or easy) and weight to the rows of a sample within the bands; hard marks negatives that were taken for positives.

    Rows of a kind stand in the order of label set and hash, and one is kept wherever the running sum of weights passes a whole
    number: each set gets its weight to within one row, and a kind its size. Rows are moved once; no task sees a whole kind.
    """
    names = rows.columns
    marked = rows.withColumn("__positive", positives(labels))
    kind = F.when(F.size("__positive") > 0, "positive").when(F.coalesce(hard, F.lit(False)), "hard").otherwise("easy")
    marked = marked.withColumn("__kind", kind)
    sets = staged(marked.groupBy("__kind", F.col("__positive").alias("positive")).agg(F.count("*").alias("n")), "label-sets")
    count = sets.agg(*[F.coalesce(F.sum(F.when(F.col("__kind") == k, F.col("n"))), F.lit(0)) for k in ("hard", "easy")]).first()
    found = sets.where("__kind = 'positive'").select("positive", "n")
    weights = label_weights(found, *count, bands)
    own = row_weight(weights, "__positive")
    total = found.agg(F.sum(F.col("n") * row_weight(weights))).first()[0] or 0.0
    size = sizes(total, *count, bands)
    share = lambda take, of: min(1.0, take / of) if of else 0.0
    weight = F.when(F.col("__kind") == "positive", own * share(size[0], total)).when(F.col("__kind") == "hard", share(size[1], count[0])).otherwise(share(size[2], count[1]))
    units = F.least(F.ceil(weight * ONE), F.lit(ONE)).cast("long")
    keyed = marked.withColumns({"__units": units, "__set": F.to_json("__positive"), "__key": hash_key(F.col(key), seed)})
    placed = running_sums(keyed, ["__kind"], ["__set", "__key", key], {"__sum": F.col("__units")})
    kept = placed.where(F.floor(F.col("__sum") / ONE) > F.floor((F.col("__sum") - F.col("__units")) / ONE))
    return kept.select(*names, F.col("__kind").alias("kind"), (F.col("__units") / ONE).alias("weight"))


def shares(rows: DataFrame, labels: str, hard: Column, bands: Bands = Bands()) -> DataFrame:
    """(bucket, n, share, low, high, status): clean and positive rows of all, hard negatives of the clean ones, and the commonest label of all
    (ties: the first by name). No rows of a kind: 0."""
    spark = rows.sparkSession
    marked = rows.select(positives(labels).alias("p"), F.coalesce(hard, F.lit(False)).alias("h"))
    clean = F.size("p") == 0
    whole = marked.agg(F.count("*").alias("all"), F.count_if(clean).alias("clean"), F.count_if(clean & F.col("h")).alias("hard"))
    top = marked.select(F.explode("p").alias("label")).groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    one = whole.crossJoin(top)  # a row each
    h = bands.hard or (0.0, 1.0)
    limits = [("clean", "clean", "all", *bands.clean), ("positive", "positive", "all", 1 - bands.clean[1], 1 - bands.clean[0]), ("hard of clean", "hard", "clean", *h), ("commonest label", "top", "all", 0.0, bands.head)]
    one = one.withColumn("positive", F.col("all") - F.col("clean"))
    cells = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(n).alias("n"), F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0)).alias("share"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high")) for b, n, of, lo, hi in limits])
    # a row more or less than a band's edge allows is still on it
    status = F.when(F.col("share") < F.col("low") - 1e-9, "below").when(F.col("share") > F.col("high") + 1e-9, "above").otherwise("ok")
    return one.select(F.explode(cells).alias("c")).select("c.*").withColumn("status", status)
