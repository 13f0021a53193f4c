"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words and their beginnings (words that share a
stem are known by it even where they are new); a document's is the noisy-or of its sentences: toxic if any sentence is. Only documents have labels; the gradient goes through the noisy-or to the sentences,
and so the fitted model also says which sentences offend.

The fit is made on a bounded, documented sample of labelled rows: SAMPLE_PER_CLASS documents of each label that have a text,
weighted back to the labels' shares. Of a text of more than SAMPLE_CHARS characters, sentences from all over it are taken, of
about as many characters together; a toxic sentence may be among those that are not. Every document is scored whole.

Results: score is 0 for null and empty texts and texts without words. Without labelled rows of both kinds every score is
the share of toxic labels (0 if none). Labels that are null or neither 0 nor 1 are left out; equal labels of a document
count once in the sample. An empty table gives no rows, repeated rows each get theirs; columns that have the name of a new
one are replaced, others of any name are kept.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm.common import drawn_by_class, staged, table, with_columns_from_batches
from curatrix.llm.language_id import held_out

SAMPLE_PER_CLASS, SAMPLE_CHARS = 2500, 20_000
#: Words, and beginnings of words of so many letters, are features if so many sampled documents have them at least, and if they
#: are so many times as frequent in toxic ones.
BEGINNINGS, LEAST_DOCUMENTS, LEAST_LIFT = (4, 5, 6, 7), 4, 1.25
#: Words whose weights a Python worker keeps; when full it starts anew.
CACHE_ENTRIES = 100_000
STEPS, RATE, SHRINK = 160, 0.15, 2e-5
#: A sentence offends from this probability on.
OFFENDS = 0.5
_SENTENCES = re.compile(r"[^.!?\n]+")
_WORDS = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings, marked by a hyphen."""
    return [word, *[word[:n] + "-" for n in BEGINNINGS if len(word) >= n]]


class SentenceModel:
    def __init__(self, weights: dict[str, float], bias: float):
        """weights: of words and of beginnings of words."""
        self.weights, self.bias = weights, bias
        self.cache: dict[str, float] = {}

    def sentence(self, text: str) -> float | None:
        words = set(_WORDS.findall(text))
        if not words:
            return None
        cache, known, found = self.cache, self.weights.get, [self.bias]
        for w in words:
            weight = cache.get(w)
            if weight is None:
                weight = math.fsum(known(f, 0.0) for f in features_of(w))
                if len(cache) >= CACHE_ENTRIES:
                    cache.clear()
                cache[w] = weight
            if weight:
                found.append(weight)
        z = math.fsum(found)  # the same in whatever order
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    def document(self, text: str | None) -> tuple[float, list[dict]]:
        """Noisy-or of the sentences, and the offending ones."""
        clean, offending = 0.0, []
        for m in _SENTENCES.finditer(text or ""):  # lower case may be longer, so places are those of the text itself
            p = self.sentence(m.group().lower())
            if p is not None:
                clean += math.log1p(-min(p, 1 - 1e-12))
                if p >= OFFENDS:
                    offending.append({"start": m.start(), "end": m.end(), "score": p})
        return -math.expm1(clean), offending

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], share: float) -> SentenceModel:
        """share: of toxic labels among all labelled rows."""
        if len(set(labels)) < 2:
            return cls({}, math.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        bags = [[set(ws) for s in _SENTENCES.findall(t) if (ws := _WORDS.findall(s.lower()))] for t in texts]
        y = np.array(labels, float)
        df = (Counter(), Counter())
        for bag, label in zip(bags, labels, strict=True):
            df[label].update({f for word in set().union(*bag) for f in features_of(word)})
        lift = LEAST_LIFT * (y.sum() + 1) / (len(y) - y.sum() + 1)
        index = {f: k for k, f in enumerate(sorted(f for f, n in df[1].items() if n + df[0][f] >= LEAST_DOCUMENTS and n + 0.5 >= lift * (df[0][f] + 0.5)))}
        of_word: dict[str, list[int]] = {}
        doc_of, sent_of, feat = [], [], []
        for d, bag in enumerate(bags):
            for words in bag:
                for word in words:
                    found = of_word.get(word)
                    if found is None:
                        found = of_word[word] = [index[f] for f in features_of(word) if f in index]
                    sent_of += [len(doc_of)] * len(found)
                    feat += found
                doc_of.append(d)
        doc_of, sent_of, feat = np.array(doc_of, np.int64), np.array(sent_of, np.int64), np.array(feat, np.int64)
        weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) / len(y)
        w, b = np.zeros(len(index)), -4.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, STEPS + 1):
            z = np.clip(np.bincount(sent_of, w[feat], len(doc_of)) + b, -30, 30)
            p = 1 / (1 + np.exp(-z))
            clean = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
            toxic = np.clip(-np.expm1(clean), 1e-9, 1)
            slope = (weight * np.where(y == 1, -(1 - toxic) / toxic, 1.0))[doc_of] * p
            g, gb = np.bincount(feat, slope[sent_of], len(w)), slope.sum()
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            scale = np.sqrt(v / fix2) + 1e-6
            w -= rate * (m / fix) / scale
            w = np.sign(w) * np.maximum(np.abs(w) - rate * SHRINK / scale, 0)  # words that carry little go to zero
            b -= rate * (mb / fix) / (math.sqrt(vb / fix2) + 1e-6)
        return cls({word: float(w[k]) for word, k in index.items() if abs(w[k]) > 1e-3}, float(b))


def excerpt(text: str, most: int | None = None) -> str:
    """The text if it has at most so many characters; else pieces of sentences at even distances, of about as many together."""
    most = most or SAMPLE_CHARS
    if len(text) <= most:
        return text
    # a sentence of any length counts as pieces of `piece` characters that end between words, so that none fills the excerpt
    piece, pieces = max(1, most // 20), []
    for sentence in _SENTENCES.findall(text):
        at = 0
        while at < len(sentence):
            end = at + piece
            if end < len(sentence):
                blank = sentence.rfind(" ", at + 1, end + 1)
                end = blank if blank > at else end
            pieces.append(sentence[at:end])
            at = end
    share = most / sum(map(len, pieces))
    step = max(1.0, 1 / share)
    return "\n".join(pieces[int(k * step)] for k in range(int(len(pieces) / step)))


def learn(docs: DataFrame, labels: DataFrame) -> SentenceModel:
    """Fits on the bounded sample; its texts come to the driver."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    there = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).where(F.length("text") >= 1)
    labelled = rows.join(there.select("doc_id", "th"), "doc_id").select("doc_id", "th", "toxic")
    chosen = staged(drawn_by_class(labelled, "toxic", [0, 1], SAMPLE_PER_CLASS, ["doc_id", "th"]), "toxicity-draws")  # 2 * SAMPLE_PER_CLASS rows at most
    cut = F.udf(lambda text: excerpt(text), "string")
    texts = there.join(F.broadcast(chosen.select("doc_id", "th").distinct()), ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.min("text").alias("text"))
    known = {(r["doc_id"], r["th"]): r["text"] for r in texts.select("doc_id", "th", cut("text").alias("text")).collect()}
    sample = sorted((known[r["doc_id"], r["th"]], r["toxic"]) for r in chosen.collect())
    return SentenceModel.fit([t for t, _ in sample], [y for _, y in sample], share)


_models: dict = {}


def score_toxicity(docs: DataFrame, model: SentenceModel, text: str = "text") -> DataFrame:
    """Appends score and offending (start, end and score of each offending sentence); columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # at most the sample's words
    key = uuid.uuid4().hex

    def make() -> Callable:
        if _models.get("key") != key:
            _models.update(key=key, model=SentenceModel(*shared.value))
        document = _models["model"].document

        def step(texts: pa.Array) -> list[pa.Array]:
            found = [document(t.as_py()) for t in texts]
            return [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(span))]

        return step

    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    fields = [T.StructField("score", T.DoubleType()), T.StructField("offending", T._parse_datatype_string("array<struct<start:long,end:long,score:double>>"))]
    return with_columns_from_batches(docs, [text], make, fields)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending")
    )
