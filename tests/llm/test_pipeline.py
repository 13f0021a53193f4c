import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from curatrix.llm import byte_bpe, language_id
from tests.llm.test_ngram_join import brute as brute_classes
from tests.llm.test_suffix_dedup import brute as brute_suffix


def test_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    model = language_id.learn(docs)
    kept = corpus_pipeline.keep_languages(spark, docs, sf_dir)
    rows = [tuple(r) for r in docs.collect()]
    want = [r for r in rows if (found := model.score(r[1]))[0] != "und" and found[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert kept.columns == columns and sorted(tuple(r) for r in kept.collect()) == sorted(want)

    near = corpus_pipeline.keep_one_of_near_copies(spark, kept, sf_dir)
    stay = {i for i, _, c in brute_classes([r[:2] for r in want], 5, 80) if i == c}
    want = sorted(r for r in want if r[0] in stay)
    assert near.columns == columns and sorted(tuple(r) for r in near.collect()) == want

    cut = corpus_pipeline.cut_repeats(spark, near, sf_dir)
    assert cut.columns == columns
    digests = {i: (n - removed, digest) for i, n, removed, _, digest in brute_suffix([r[:2] for r in want], corpus_pipeline.PASSAGE_BYTES)}
    got = {r.doc_id: r for r in cut.collect()}
    assert got.keys() == digests.keys()
    for i, (n, digest) in digests.items():
        data = got[i].text.encode()
        assert got[i].n_chars == len(got[i].text)
        assert hashlib.sha256(data).hexdigest() == digest or n - 6 * len(data) < len(data) < n

    mixed = corpus_pipeline.mix_sources(spark, cut, sf_dir)
    assert mixed.columns == columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert times.keys() == got.keys() and max(times.values()) <= np.ceil(corpus_pipeline.mixing.MAX_REPETITION)
    encoded = corpus_pipeline.encode(spark, mixed, sf_dir).collect()
    assert Counter(r.doc_id for r in encoded) == times
    assert all(r.decoded_sha256 == hashlib.sha256(got[r.doc_id].text.encode()).hexdigest() for r in encoded)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == times
    assert byte_bpe.default_ranks()


def test_edge_cases(spark):
    text = " ".join(f"word{k} other" for k in range(80))
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (3, "12 34", None, "s", 5), (4, text, "en", "s", 9), (5, text, "fr", "t", 9), (5, text, "fr", "t", 9), (None, text, "en", "s", 1),
            (None, "quite another text without any id", "en", "s", 1), (None, "quite another text without any id", "en", "s", 1), (7, "one more text of a few words", "en", None, 1), (7, "one more text of a few words", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert sorted((str(r.doc_id) for r in near.collect())) == ["1", "2", "3", "4", "7", "None"]
    for stage in (corpus_pipeline.cut_repeats, corpus_pipeline.mix_sources):
        assert stage(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.cut_repeats(spark, docs, "").count() == len(rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    assert corpus_pipeline.keep_languages(spark, docs, "").count() <= len(rows)


def test_columns_of_any_name_pass_all_stages(spark):
    names = ["cut", "e", "last", "s", "b", "n", "h", "q", "good", "rows", "stay_id", "score", "lang_pred", "kept", "n_bytes", "n_tokens", "position", "epoch", "block", "node", "comp", "d", "t"]
    passage = " ".join(f"shared{k} words" for k in range(60))
    texts = [" ".join(f"alone{k}x{j} word" for j in range(40)) + (" " + passage if k % 2 else "") for k in range(12)] + [None, ""]
    rows = [(k, t, "en", f"s{k % 2}", 7, *[f"{c}{k}" for c in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)
        if stage is corpus_pipeline.cut_repeats:
            assert not any(passage in (r.text or "") for r in got) and len(got) == len(rows)
    assert corpus_pipeline.encode(spark, docs, "").count() == len(rows)


def test_passages_of_51_words_are_cut(spark):
    passage = " ".join(f"word{k}" for k in range(51))
    assert 250 <= len(passage) < 400
    rows = [(k, f"begin {k} {'x' * k} {passage} end {k}", "en", "s", 1) for k in range(3)] + [(9, "clean text " * 10, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert all(passage not in got[k].text and got[k].text.startswith("begin") and got[k].n_chars == len(got[k].text) for k in range(3))
    assert got[9].text == "clean text " * 10 and got[9].n_chars == 1
