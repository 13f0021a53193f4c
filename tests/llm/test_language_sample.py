"""What the fit learns from: no language is lost to long texts, copies or many languages."""

from collections import Counter

from curatrix.llm import language_id


def learned(spark, rows):
    return language_id.training_words(spark.createDataFrame(rows, "text string, lang string"))


def test_long_texts_copies_and_many_languages_are_learned(spark):
    books = [(f"buch{chr(97 + k)} " + "wort " * 2000, "de") for k in range(3)]
    copies = [(t, "xx") for t in ("once one", "twice two") for _ in range(5000)]
    many = [(f"word l{chr(97 + k // 26)}{chr(97 + k % 26)}", f"l{k:02d}") for k in range(70)]
    got = learned(spark, [*books, *copies, *many, ("12 34", "digits"), (None, "none"), ("no language", None)])
    assert got.keys() == {"de", "xx", *(f"l{k:02d}" for k in range(70))}
    assert {"bucha", "buchb", "buchc"} <= got["de"].keys()
    assert got["xx"] == Counter("once one twice two".split())
    assert got["l69"] == Counter(["word", "lcr"])


def test_sample_is_bounded_and_short_texts_come_first(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANGUAGE", 5)
    short = [(f"kurz{chr(97 + k)}", "de") for k in range(9)]
    got = learned(spark, [*short, ("lang " * 1000, "de"), *short])
    assert len(got["de"]) == 5 and set(got["de"].values()) == {1} and "lang" not in got["de"]
    monkeypatch.setattr(language_id, "MOST_TEXTS", 3)
    got = learned(spark, [*short, *((t, "xx") for t, _ in short)])
    assert {k: len(v) for k, v in got.items()} == {"de": 1, "xx": 1}
