"""Columns on scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix.functions.labels import CLASSES, constants


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp_probability(p: Column) -> Column:
    """Into 0..1; 0 for what is no finite number."""
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def softmax2(logits: Column) -> Column:
    """Second probability of two logits."""
    return sigmoid(logits[1] - logits[0])


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def confidence_band(p: Column) -> Column:
    return F.when((p >= 0.95) | (p <= 0.05), "high").when((p >= 0.80) | (p <= 0.20), "medium").otherwise("low")


def predict_labels(scores: dict[str, Column], thresholds: dict[str, float], allow_empty: bool = False) -> Column:
    """Labels whose score reaches the threshold, in order of classes; clean only by itself, and where nothing else is left."""
    found = F.array_compact(F.array(*[F.when(scores[c] >= thresholds[c], F.lit(c)) for c in CLASSES]))
    found = F.when(F.size(found) > 1, F.array_remove(found, "clean")).otherwise(found)
    return found if allow_empty else F.when(F.size(found) == 0, constants(["clean"])).otherwise(found)


def decide(p_scam: Column, p_topic: Column, scam_at: float, topic_at: float) -> Column:
    """One label: scam, else topic, else clean."""
    return F.when(p_scam >= scam_at, "scam").when(p_topic >= topic_at, "topic_crypto").otherwise("clean")


def build_thresholds(overrides: dict[str, float], default: float = 0.5) -> dict[str, float]:
    return {c: overrides.get(c, default) for c in CLASSES}
