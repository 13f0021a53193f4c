"""Sweeps: candidates fitted together over one table of packed features, thresholds by policy on calibration rows, one pass of metrics over the holdout."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.scores import safe_div
from curatrix.operators.logistic import PACKED, LogisticModel, LogisticRegression, fit_together, packed_entries, scores
from curatrix.operators.thresholds import tune_fpr
from curatrix.operators.training import BUCKETS, balanced, packed_rows
from curatrix.sources.files import staged

#: Kinds of features that a candidate may use, and where they lie among all.
PARTS = {part: (k * BUCKETS, (k + 1) * BUCKETS) for k, part in enumerate(("words", "pairs", "chars"))}
#: False-positive rates that a policy grants each label on the calibration rows.
POLICIES = {"strict": {"scam": 0.02, "topic_crypto": 0.03}, "relaxed": {"scam": 0.02, "topic_crypto": 0.2}}


@dataclass(frozen=True)
class Candidate:
    name: str
    parts: tuple[str, ...] = ("words", "pairs", "chars")
    reg: float = 0.01
    iterations: int = 8
    weighted: bool = True


def feature_table(rows: DataFrame, text: str, labels: str, keep: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """(keep, y_<class>, packed counts of all PARTS), written once: all candidates are fitted and scored from it. Null labels are none."""
    marks = [F.coalesce(F.array_contains(labels, c), F.lit(False)).alias(f"y_{c}") for c in classes]
    return packed_rows(rows, text, [*keep, *marks], "features")


def fit_candidates(train: DataFrame, candidates: Sequence[Candidate], classes: Sequence[str]) -> dict[tuple[str, str], LogisticModel]:
    """(candidate, class): the model; classes whose rows are all of one kind have none. All models take their steps in the same passes."""
    counts = train.agg(F.count("*").alias("rows"), *[F.count_if(f"y_{c}").alias(c) for c in classes]).first()
    total = counts["rows"]
    wanted = {
        (one.name, c): LogisticRegression(f"y_{c}", len(PARTS) * BUCKETS, balanced(counts[c], total) if one.weighted else (1.0, 1.0), one.reg, one.iterations, tuple(PARTS[p] for p in one.parts))
        for one in candidates
        for c in classes
        if 0 < counts[c] < total
    }
    return dict(zip(wanted, fit_together(train, list(wanted.values())), strict=True)) if wanted else {}


def score_candidates(features: DataFrame, candidates: Sequence[Candidate], models: dict[tuple[str, str], LogisticModel], keep: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """(keep, model, y_<class>, s_<class>): a row for each row and candidate, from one reading of the features; 0 where there is no model."""
    at = {k: n for n, k in enumerate(models)}
    told = lambda one, c: (F.col("__s")[at[one.name, c]] if (one.name, c) in at else F.lit(0.0)).alias(f"s_{c}")
    cells = [F.struct(F.lit(one.name).alias("model"), *[told(one, c) for c in classes]) for one in candidates]
    marks = [f"y_{c}" for c in classes]
    out = features.select(*keep, *marks, scores(packed_entries, list(models.values()))(F.struct(*PACKED)).alias("__s"))
    return out.select(*keep, *marks, F.explode(F.array(*cells)).alias("c")).select(*keep, *marks, "c.*")


def policy_thresholds(calib: DataFrame, policies: dict[str, dict[str, float]], classes: Sequence[str]) -> DataFrame:
    """(model, policy, t_<class>, f_<class>): for each policy the threshold of most recall within the class's rate on calib, and its rate there.

    Rows are counted once for each rate that some policy grants a class, however many policies grant it.
    """
    spark = calib.sparkSession
    granted = [(p, c, float(rates[c])) for p, rates in policies.items() for c in classes]
    rates = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(r).alias("rate"), F.col(f"s_{c}").alias("score"), F.col(f"y_{c}").alias("positive")) for c, r in sorted({(c, r) for _, c, r in granted})])
    long = calib.select("model", F.explode(rates).alias("c")).select("model", "c.*")
    found = tune_fpr(long, ["model", "label", "rate"], "score", F.col("positive"), F.col("rate"))
    table = F.broadcast(spark.createDataFrame(granted, "policy string, label string, rate double"))  # a row for each policy and class
    of = lambda c, column: F.max(F.when(F.col("label") == c, F.col(column)))
    return found.join(table, ["label", "rate"]).groupBy("model", "policy").agg(*[of(c, "threshold").alias(f"t_{c}") for c in classes], *[of(c, "fpr").alias(f"f_{c}") for c in classes])


def sweep_metrics(holdout: DataFrame, thresholds: DataFrame, classes: Sequence[str]) -> DataFrame:
    """A row for each model and policy: thresholds, rates on calib, and on holdout precision, recall and fpr of each class, micro and macro F1
    (with clean: none of the classes), exact_match and n.

    thresholds has a row for each model and policy, so that one aggregation over the scored rows gives all of it.
    """
    both = holdout.join(F.broadcast(thresholds), "model")
    gold, hit = {c: F.col(f"y_{c}") for c in classes}, {c: F.col(f"s_{c}") >= F.col(f"t_{c}") for c in classes}
    none: dict[str, Column] = {"clean": ~reduce(lambda a, b: a | b, gold.values())}
    missed: dict[str, Column] = {"clean": ~reduce(lambda a, b: a | b, hit.values())}
    gold, hit = gold | none, hit | missed
    count = lambda x, name: F.count_if(x).alias(name)
    sums = [x for c in gold for x in (count(gold[c] & hit[c], f"tp_{c}"), count(~gold[c] & hit[c], f"fp_{c}"), count(gold[c], f"n_{c}"))]
    same = reduce(lambda a, b: a & b, [gold[c] == hit[c] for c in classes])
    fixed = [f"{x}_{c}" for x in "tf" for c in classes]
    out = both.groupBy("model", "policy", *fixed).agg(*sums, F.avg(same.cast("double")).alias("exact_match"), F.count("*").alias("n"))
    tp, fp, n = (lambda c: F.col(f"tp_{c}")), (lambda c: F.col(f"fp_{c}")), (lambda c: F.col(f"n_{c}"))
    total = lambda f: reduce(lambda a, b: a + b, [f(c) for c in gold])
    f1 = lambda c: safe_div(2 * tp(c), tp(c) + fp(c) + n(c))
    told = [x for c in classes for x in (
        F.col(f"t_{c}").alias(f"{c}_threshold"), F.col(f"f_{c}").alias(f"{c}_calib_fpr"), safe_div(tp(c), tp(c) + fp(c)).alias(f"{c}_precision"),
        safe_div(tp(c), n(c)).alias(f"{c}_recall"), safe_div(fp(c), F.col("n") - n(c)).alias(f"{c}_fpr"),
    )]
    return out.select("model", "policy", *told, safe_div(2 * total(tp), total(tp) + total(fp) + total(n)).alias("micro_f1"), (total(f1) / len(gold)).alias("macro_f1"), "exact_match", "n")


def sweep(rows: DataFrame, text: str, labels: str, split: str, candidates: Sequence[Candidate], policies: dict[str, dict[str, float]] = POLICIES, classes: Sequence[str] = ("scam", "topic_crypto")) -> DataFrame:
    """sweep_metrics of candidates that are fitted on rows of split train, with thresholds from calib, on holdout."""
    features = feature_table(rows.where(F.col(split).isin("train", "calib", "holdout")), text, labels, [split], classes)
    models = fit_candidates(features.where(F.col(split) == "train"), candidates, classes)
    scored = staged(score_candidates(features.where(F.col(split) != "train"), candidates, models, [split], classes), "scores")
    found = staged(policy_thresholds(scored.where(F.col(split) == "calib"), policies, classes), "policy-thresholds")
    return sweep_metrics(scored.where(F.col(split) == "holdout"), found, classes)
