import math

import numpy as np
import pytest

from curatrix.llm import mixing


def test_exponent_meets_its_target():
    tokens = [10_000, 3_000, 500, 500, 0]
    for limit in (1.0, 1.5, 4.0, 1000.0):
        weights = mixing.tempered(tokens, mixing.bisected(tokens, max_repetition=limit))
        assert mixing.repetition(tokens, weights) <= limit + 1e-9
        assert math.isclose(sum(weights), 1)
        if 1 < limit < 20:
            assert math.isclose(mixing.repetition(tokens, weights), limit, rel_tol=1e-9)
    for target in (0.9, 1.1, 1.3):
        assert math.isclose(mixing.entropy(mixing.tempered(tokens, mixing.bisected(tokens, target_entropy=target))), target, rel_tol=1e-9)
    assert mixing.bisected(tokens, target_entropy=99.0) == 0.0 and mixing.bisected([0, 0], max_repetition=2) == 1.0
    with pytest.raises(ValueError):
        mixing.bisected(tokens)


def test_budgets_are_realised(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 400)
    rng = np.random.default_rng(1)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 60))) + f"\n{k}", "abc"[min(2, int(rng.integers(0, 12)) // 5)], "x") for k in range(600)]
    rows += [(None, "no id", "c", "x"), (900, None, "c", "x"), (901, "", "c", "x"), (902, "null source", None, "x"), (903, "again " * 30, "b", "x"), (903, "again " * 30, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Epoch string")
    for options in ({"max_repetition": 2.5}, {"target_entropy": 1.0, "budget": 9000.0}):
        p = mixing.plan(df.withColumn("n_tokens", mixing.token_count()).na.fill({"source": ""}), "source", "n_tokens", options.get("target_entropy"), options.get("max_repetition"), options.get("budget"))
        got = mixing.mix(df, **options).collect()
        assert set(got[0].asDict()) == {"doc_id", "text", "source", "n_tokens", "epoch", "block", "position"}
        longest = max(r.n_tokens for r in got)
        for name, weight in p.weights.items():
            own = [r for r in got if (r.source or "") == name]
            want = weight * p.budget
            assert want - 1 <= sum(r.n_tokens for r in own) < want + 2 * longest
            last = max(r.epoch for r in own)
            for epoch in range(last):
                assert sorted((str(r.doc_id), str(r.text)) for r in own if r.epoch == epoch) == sorted((str(i), str(t)) for i, t, s, _ in rows if (s or "") == name)
            assert len({(r.doc_id, r.text) for r in own if r.epoch == last}) + (1 if name == "b" and any(r.doc_id == 903 for r in own if r.epoch == last) else 0) == sum(r.epoch == last for r in own)
        assert all(0 <= r.position < 1 for r in got)
    assert mixing.mix(df.limit(0), max_repetition=2).count() == 0
    assert mixing.mix(df.where("text is null or text = ''"), max_repetition=2).count() == 2


def test_token_count(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("a b\nc",)], "text string")
    assert [r[0] for r in df.select(mixing.token_count()).collect()] == [0, 0, 1, 3]


def test_query(spark, sf_dir):
    got = mixing.op1_mixing(spark, sf_dir).collect()
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in got if r.epoch == 0} == ids
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
