from collections import Counter

import numpy as np
from pyspark.sql import Row

from curatrix.llm import language_id, toxicity


def segmentations(word, weights, other, k):
    """Sum over all ways to cut `_word`, by recursion over cuts."""
    text = "_" + word

    def total(at):
        if at == len(text):
            return 1.0
        out = 0.0
        for end in range(at + 1, min(len(text), at + language_id.LONGEST_PIECE) + 1):
            piece = text[at:end]
            w = weights.get(piece) if piece != "_" else None
            if w is not None:
                out += w[k] * total(end)
            elif end == at + 1:
                out += other[k] * total(end)
        return out

    return total(0)


def test_forward_sums_all_segmentations():
    pieces = ["_a", "a", "b", "ab", "_ab", "aba", "ba"]
    rng = np.random.default_rng(0)
    model = language_id.PieceModel(["x", "y"], pieces, rng.random((len(pieces) + 1, 2)))
    for word in ("a", "ab", "abab", "zab", "abazb", "bbbbba"):
        for k in range(2):
            want = np.log(segmentations(word, {p: model.weights[i] for p, i in model.index.items()}, model.weights[-1], k))
            assert np.isclose(model.forward(word)[k], want) and np.isclose(model.forward_many(["b", word, "zz"])[1, k], want)
    assert np.isfinite(model.forward("ab" * 20_000)).all()


def test_fit_separates_and_und(spark):
    counts = {"x": Counter({"abab": 5, "ab": 9}), "y": Counter({"cdcd": 5, "dc": 9})}
    model = language_id.PieceModel.fit(counts, ["a", "b", "c", "d", "ab", "cd", "_ab", "_cd"])
    assert model.score("ab ab abab")[0] == "x" and model.score("CDCD")[0] == "y"
    rows = [Row(doc_id=1, text=None), Row(doc_id=2, text=""), Row(doc_id=None, text="12 --"), Row(doc_id=3, text="ab " * 100_000), Row(doc_id=3, text="ñ"), Row(doc_id=4, text="ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as Score", "1 as lang_pred")
    got = language_id.identify(df, model).collect()
    assert [(r.lang_pred, r.score) for r in got[:3]] == [("und", 0.0)] * 3
    assert got[3].lang_pred == got[5].lang_pred == "x" and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.learn(none).score("hello") == ("und", 0.0)
    assert language_id.identify(none, model).count() == 0


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(len(scores))
    for s in np.unique(scores):
        ranks[scores == s] = ranks[scores == s].mean()
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op8_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    y = np.array([r.toxic for r in got])
    assert auc(np.array([r.score for r in got]), y) > 0.97
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97


def test_offending_sentences_and_edge_cases(spark):
    texts = [f"good words here {k}. nothing bad at all." for k in range(40)] + [f"good words here. you awful thing. more words {k}." for k in range(40)]
    model = toxicity.SentenceModel.fit(texts, [0] * 40 + [1] * 40, 0.5)
    score, spans = model.document("more words. you awful thing. good words")
    assert score > 0.5 and [texts and "more words. you awful thing. good words"[s["start"] : s["end"]].strip() for s in spans] == ["you awful thing"]
    assert model.document("good words here")[0] < 0.5
    rows = [Row(doc_id=1, text=None), Row(doc_id=2, text=""), Row(doc_id=None, text="?!."), Row(doc_id=3, text="good words. " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as SCORE", "1 as offending")
    got = toxicity.score_toxicity(df, model).collect()
    assert [r.score for r in got[:3]] == [0.0] * 3 and 0 <= got[3].score <= 1
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), nothing)
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
