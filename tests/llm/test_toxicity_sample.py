"""Toxic documents that capitals or long texts must not hide."""

from curatrix.llm import toxicity


def test_capitals_count_whatever_letters_are_near():
    model = toxicity.SentenceModel({"awful": 20.0}, -10.0)
    text = "\u0130zmir is fine. AWFUL thing! Good"
    score, spans = model.document(text)
    assert score > 0.9 and [text[s["start"] : s["end"]] for s in spans] == [" AWFUL thing"]


def test_labels_with_long_documents_are_learned(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 200)
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 20)
    bad = "you awful thing. " * 40
    rows = [(k, f"good words here {k}." if k % 2 else bad) for k in range(100)] + [(k, "") for k in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.document("you awful thing")[0] > 0.5 > model.document("good words here")[0]


def test_excerpts_are_spread_and_bounded():
    text = "".join(f"sentence number {k}. " for k in range(5000))
    got = toxicity.excerpt(text, 2000)
    numbers = [int(s.split()[-1]) for s in got.split("\n")]
    assert len(got) < 2500 and numbers[0] < 100 and numbers[-1] > 4800 and len(numbers) > 50
    assert toxicity.excerpt("a. b", 2000) == "a. b"
    assert 500 < len(toxicity.excerpt("word " * 10_000, 2000)) < 2500
