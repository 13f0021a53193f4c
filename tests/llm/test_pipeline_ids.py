"""The near-copy stage where ids repeat or are missing."""

import corpus_pipeline


def test_one_row_of_each_component_stays(spark):
    text = lambda name: " ".join(f"{name}{k} other" for k in range(80))
    near = lambda name: text(name) + " tail"
    rows = [
        (1, text("a")), (1, text("b")), (2, near("b")),  # one id, two unlike texts: each is the smallest of its group
        (None, text("c")), (None, near("c")), (None, near("c")),  # near copies of which none has an id
        (None, text("d")), (3, near("d")),
        (4, ""), (4, "--"), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()]
    assert len(got) == len(set(got)) == 7
    assert {(1, text("a")), (1, text("b")), (3, near("d")), (4, ""), (4, "--"), (None, None)} < set(got)
    assert len({text("c"), near("c")} & {t for i, t in got if i is None}) == 1
