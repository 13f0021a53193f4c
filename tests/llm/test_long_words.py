"""Words of any length are learned from, and columns of any name pass."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from curatrix.llm import byte_bpe, language_id, piece_bpe


def test_scripts_without_blanks_are_learned(spark):
    """Runs of 65, 90 and 5,000 letters without a blank, in languages that have nothing else."""
    rng = random.Random(1)
    letters = {"zh": [chr(0x4E00 + k) for k in range(60)], "th": [chr(0x0E01 + k) for k in range(40)], "en": list("abcdefgh")}
    size = {"zh": [65, 90, 5000], "th": [90], "en": [5]}
    rows = []
    for k in range(150):
        for lang, own in letters.items():
            n = rng.choice(size[lang])
            words = 1 if lang != "en" else 18
            rows.append((len(rows), " ".join("".join(rng.choices(own, k=n)) for _ in range(words)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify(docs, language_id.learn(docs)).where(language_id.held_out()).collect()
    assert {r.lang for r in found} == set(letters)
    assert all(r.lang_pred == r.lang and r.score > 0.5 for r in found)


def test_long_words_count_as_short_ones_do():
    pieces = ["_", "_a", "a", "ab", "b", "ba", "aba"]
    weights = np.random.default_rng(2).random((len(pieces) + 1, 1))
    model = language_id.PieceModel(["x"], pieces, weights / weights.sum())
    words = Counter({"abab": 3, "b": 1, "aabbabac": 2})
    plain = model.expected([words])[:, 0]
    out = np.zeros(len(pieces) + 1)
    model.expected_long(list(words), words, model.weights[:, 0], out)
    assert np.allclose(out, plain)
    longest = "ab" * 2500
    out = np.zeros(len(pieces) + 1)
    model.expected_long([longest], Counter([longest]), model.weights[:, 0], out)
    sizes = np.array([len(p) for p in pieces] + [1])
    assert math.isclose(out @ sizes, len(longest) + 1, rel_tol=1e-9)  # pieces cover the word and its mark


def test_the_vocabulary_has_all_letter_pieces():
    assert max(map(len, language_id.vocabulary(language_id.default_vocabulary()))) > 12


def test_any_column_name_passes(spark):
    docs = spark.createDataFrame([(k, f"words of text {k}", "en" if k % 2 else "de", k) for k in range(20)], "doc_id long, text string, lang string, __in0 long")
    docs = docs.withColumns({"__in1": F.lit("x"), "__user0": F.lit(1)})
    for out in (
        language_id.identify(docs, language_id.learn(docs)),
        byte_bpe.encode_and_decode(docs, *byte_bpe.default_ranks()),
        piece_bpe.encode_and_decode(docs, piece_bpe.default_model()),
    ):
        assert sorted((r["doc_id"], r["__in0"], r["__in1"], r["__user0"]) for r in out.collect()) == [(k, k, "x", 1) for k in range(20)]
