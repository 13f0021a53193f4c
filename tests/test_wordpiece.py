"""Fixed-length encoding against a plain greedy search that knows nothing of trees or patterns."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from curatrix.operators import wordpiece


def plain_tokens(text):
    text = unicodedata.normalize("NFKC", text)
    text = "".join(c for c in text if c not in "​‌‍⁠﻿").lower()
    out, word = [], ""
    for c in text:
        if c in "\t\n\x0b\x0c\r \xa0     　" or " " <= c <= " ":
            out, word = [*out, word], ""
        elif c <= "\x1f" or "\x7f" <= c <= "\x9f":
            continue
        elif unicodedata.category(c)[0] in "PS" or 0x4E00 <= ord(c) <= 0x9FFF or 0x3400 <= ord(c) <= 0x4DBF or 0x20000 <= ord(c) <= 0x2A6DF:
            out, word = [*out, word, c], ""
        else:
            word += c
    return [t for t in [*out, word] if t]


def plain(text, ids, length):
    out = ["[CLS]"]
    for token in plain_tokens(text or ""):
        pieces, at = [], 0
        while at < len(token) and pieces != ["[UNK]"]:
            end = next((e for e in range(len(token), at, -1) if ("##" if at else "") + token[at:e] in ids), None)
            pieces, at = (["[UNK]"], at) if end is None or len(token) > 100 else ([*pieces, ("##" if at else "") + token[at:end]], end)
        out += pieces
    out = [ids[t] for t in [*out, "[SEP]"]]
    if len(out) > length:
        out = [*out[: length - 1], ids["[SEP]"]]
    return out


WORDS = ["word", "wor", "d", "##d", "##ds", "##s", "a", "b", "##a", "##b", "##ab", "ab", ",", "!", "日", "本", "日本", "##本", "é", "##é", "x" * 100, "##" + "x" * 40, "##", "##x", "x", "$", "1", "##1", "\U0001f600", "##!"]
TEXTS = [
    None, "", "  ", "word,", "Words!word", "日本語 日本", "a日b", "x" * 100, "x" * 101, "x" * 99, "ab" * 30 + "c", "aaaa bbbb", "a\x01b\x7fa\x85b", "a\x1cb", "WO​RD", "ｗｏｒｄ！", "é é", "$1 €1",
    "word " * 500, ", " * 94 + "word", "a " * 93 + "abs abs", "\U0001f600\U00020001a", "a　b a\x0bb", "##s [CLS] [UNK]",
]


def ids_of(words):
    return {t: k for k, t in enumerate([*wordpiece.SPECIAL, *words])}


def test_equals_plain_search(spark):
    ids = ids_of(WORDS)
    vocabulary = spark.createDataFrame([*ids.items(), ("word", 999), (None, 7)], "token string, id long")
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(3, "word,")], "doc_id long, text string")
    got = wordpiece.encode_batch(rows, "doc_id", "text", vocabulary).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = plain(TEXTS[r.doc_id], ids, 96)
        assert len(r.ids) == len(r.mask) == 96
        assert r.ids == want + [0] * (96 - len(want)), TEXTS[r.doc_id]
        assert r.mask == [1] * len(want) + [0] * (96 - len(want))
        assert r.ids[len(want) - 1] == ids["[SEP]"]
    assert wordpiece.encode_batch(rows.limit(0), "doc_id", "text", vocabulary).count() == 0


def test_random_vocabularies_and_texts():
    rng = random.Random(2)
    for _ in range(200):
        words = {rng.choice(["", "##"]) + "".join(rng.choices("abc,é日", k=rng.randrange(1, 6))) for _ in range(rng.randrange(40))}
        ids = ids_of(sorted(words))
        encoder = wordpiece.Encoder(ids)
        for _ in range(20):
            text = "".join(rng.choices("abcABC,é日 \t\x02", k=rng.randrange(60)))
            for length in (2, 5, 96):
                assert encoder.encode(text, length) == plain(text, ids, length)


def test_vocabularies_that_do_not_do(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match=r"\[SEP\]"):
        wordpiece.encode_batch(rows, "doc_id", "text", spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("[CLS]", 2)], "token string, id long"))
    monkeypatch.setattr(wordpiece, "VOCABULARY_BYTES", 5)
    with pytest.raises(ValueError, match="too large"):
        wordpiece.vocabulary_ids(spark.createDataFrame([("abcdef", 0)], "token string, id long"))


def test_query(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    vocabulary = wordpiece.vocabulary_from(table("benchmark"), "text")
    ids = {r.token: r.id for r in vocabulary.collect()}
    assert sorted(ids.values()) == list(range(len(ids))) and len(ids) == vocabulary.count() > 500
    assert vocabulary.where(F.length("token") > 12).count() > 0
    texts = {r.doc_id: r.text for r in table("documents").collect()}
    got = __spark_entry__.queries()["encode_batch"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = plain(texts[r.doc_id], ids, 96)
        assert r.n == len(want) and r.ids == " ".join(map(str, want + [0] * (96 - len(want))))
