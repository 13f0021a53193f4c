"""Quality by hierarchical empirical Bayes: a document's own evidence, its host's and its path's.

1. A logistic classifier on counts of characters, lines and words gives each document a probability p of good quality.
2. Grouped sums of p by path and host: a host's rate shrinks towards the global one, a path's towards its host's. How
   strongly, is estimated from how much the rates of the groups differ beyond chance (method of moments), for each level.
3. The score adds the document's log odds against the global rate to those of its path, which leave out its own p.

The classifier is fitted on a bounded, documented sample of labelled rows (SAMPLE_PER_CLASS of each label, weighted back);
rates and strengths come from all documents. Results: null and empty texts count as texts without characters; a null host
or path is a group of its own; a label that is null or not 0 or 1 is left out. Without labels of both kinds p is the share
of good labels (a half if none). score is in 0..1, keep is score >= 0.5. Repeated rows each count (a repeated label once in
the sample); an empty table gives no rows. Columns that have the name of a new one are replaced, others of any name are kept.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import bounded_broadcast, drawn_by_class, masked, staged, table, with_columns_from_batches, without
from curatrix.llm.language_id import held_out

SAMPLE_PER_CLASS = 4000
STEPS, RIDGE = 40, 1e-3
#: Bounds of the strengths, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0

#: Classes of bytes; the rest (beyond ASCII) counts as letters.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?", b";:", b"'\"", b"()[]{}", b"|", b"*", b"#", b"%", b"$&@", b"<>=/\\", b"-_~^`+"]
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _k


def features(text: str | None) -> list[float]:
    """Shares of byte classes, and lengths and repetitions of lines and words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, counts, len(_CLASSES) + 1) / n
    words, lines = data.split(), data.split(b"\n")
    unlike_lines, unlike_words = len(set(lines)), len(set(words))
    return [
        *np.sqrt(shares), math.log1p(len(data)) / 10, len(data) / max(1, len(words)) / 10, unlike_words / max(1, len(words)),
        unlike_lines / max(1, len(lines)), math.log1p(len(data) / len(lines)) / 10, float(np.count_nonzero(counts)) / 100,
    ]


class Classifier:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, share: float) -> Classifier:
        """Weighted ridge logistic regression by Newton steps; columns, their squares and a constant."""
        x = np.concatenate([x, x * x], axis=1)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
        rows = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(y)
        w = np.zeros(z.shape[1])
        ridge = np.full(len(w), RIDGE)
        ridge[-1] = 1e-9
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (rows * (p - y)) + ridge * w
            bend = (z * (rows * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            move = np.linalg.solve(bend, slope)
            w -= move * min(1.0, 5 / max(1e-9, float(np.abs(move).max())))
            if np.abs(move).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def probability(self, x: np.ndarray) -> np.ndarray:
        x = np.concatenate([x, x * x], axis=1)
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def learn(docs: DataFrame, labels: DataFrame) -> Classifier | float:
    """Fits on the bounded sample; its features come to the driver. Without labels of both kinds: the share of good ones."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out())
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    chosen = staged(drawn_by_class(rows.select("doc_id", "quality"), "quality", [0, 1], SAMPLE_PER_CLASS, ["doc_id"]), "quality-draws")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * SAMPLE_PER_CLASS rows at most

    def make() -> Callable:
        return lambda column: [pa.array([features(t.as_py()) for t in column], pa.list_(pa.float64()))]

    found = with_columns_from_batches(texts.select("quality", "text"), ["text"], make, [T.StructField("x", T.ArrayType(T.DoubleType()))]).select("quality", "x").collect()
    y = np.array([r["quality"] for r in found], float)
    if len(set(y)) < 2:
        return share
    return Classifier.fit(np.array([r["x"] for r in found]), y, share)


_models: dict = {}


def with_probability(docs: DataFrame, model: Classifier | float, text: str = "text") -> DataFrame:
    """Appends p, the classifier's probability of good quality."""
    if not isinstance(model, Classifier):
        return without(docs, ["p"]).withColumn("p", F.lit(float(model)))
    shared, key = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights)), uuid.uuid4().hex

    def make() -> Callable:
        if _models.get("key") != key:
            _models.update(key=key, model=Classifier(*shared.value))
        model = _models["model"]
        return lambda column: [pa.array(model.probability(np.array([features(t.as_py()) for t in column])) if len(column) else [], pa.float64())]

    return with_columns_from_batches(docs, [text], make, [T.StructField("p", T.DoubleType())])


def strength(groups: DataFrame, n: str, total: str, parent: str) -> float:
    """Method of moments: in how many documents' worth the groups' rates are held to their parents'.

    Of rates r with n documents around parents m: E[(r - m)^2] = m (1 - m) (1 / n + (1 - 1 / n) / (strength + 1)), roughly.
    """
    rate = F.col(total) / F.col(n)
    spread = F.col(parent) * (1 - F.col(parent))
    a = groups.where(F.col(n) > 1).agg(F.sum(F.col(n) * (rate - F.col(parent)) ** 2).alias("seen"), F.sum(spread).alias("chance"), F.sum(spread * (F.col(n) - 1)).alias("room")).first()
    if not a["room"]:
        return MOST_STRENGTH
    share = ((a["seen"] or 0.0) - a["chance"]) / a["room"]
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / share - 1 if share > 0 else MOST_STRENGTH))


def _logit(c):
    return F.log(c / (1 - c))


def site_quality(docs: DataFrame, host: str, path: str, p: str = "p") -> DataFrame:
    """Appends host_rate, path_rate (without the document's own p), score and keep; columns of these names are replaced."""
    docs, back = masked(docs, [host, path, p])
    rows = staged(docs.withColumnsRenamed({host: "__host", path: "__path", p: "__p"}), "quality-evidence")
    given, (host, path, p) = (host, path, p), ("__host", "__path", "__p")
    by_path = staged(rows.groupBy(F.col(host).alias("h"), F.col(path).alias("q")).agg(F.count("*").alias("n"), F.sum(p).alias("good")), "quality-paths")
    by_host = staged(by_path.groupBy("h").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "quality-hosts")
    whole = by_host.agg(F.sum("host_good") / F.sum("host_n")).first()[0]
    mean = min(max(whole if whole is not None else 0.5, 1e-4), 1 - 1e-4)
    host_strength = strength(by_host.withColumn("mean", F.lit(mean)), "host_n", "host_good", "mean")
    rate = (F.col("host_good") + host_strength * mean) / (F.col("host_n") + host_strength)
    hosts = by_host.select(F.col("h").alias("hh"), rate.alias("host_rate"))
    paths = by_path.join(hosts, by_path.h.eqNullSafe(F.col("hh"))).drop("hh")
    path_strength = strength(paths, "n", "good", "host_rate")
    out = rows.join(bounded_broadcast(staged(paths, "quality-rates"), 64), F.col(host).eqNullSafe(F.col("h")) & F.col(path).eqNullSafe(F.col("q")))
    own = F.least(F.greatest(F.col(p), F.lit(1e-5)), F.lit(1 - 1e-5))
    out = out.withColumn("path_rate", (F.col("good") - F.col(p) + path_strength * F.col("host_rate")) / (F.col("n") - 1 + path_strength))
    bounded = F.least(F.greatest(F.col("path_rate"), F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = _logit(own) - _logit(F.lit(mean)) + _logit(bounded)
    out = out.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("keep", F.col("score") >= 0.5)
    return back(out.withColumnsRenamed(dict(zip((host, path, p), given, strict=True))), ["host_rate", "path_rate", "score", "keep"])


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their source as host and their language as the path under it."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    found = with_probability(docs.select("doc_id", "source", "lang", "text"), model).drop("text")
    return site_quality(found, "source", "lang").select("doc_id", held_out().alias("held_out"), "p", "host_rate", "path_rate", "score", "keep")
