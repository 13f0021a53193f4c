"""Exclusion of labels, several labels a row, two stages, and the order of candidates."""

from curatrix.operators import thresholds, training
from curatrix.sources.files import shared_path


def test_excluded_labels_go_and_rows_left_without_any(spark):
    rows = [(1, ["scam", "promo"]), (2, ["promo"]), (3, []), (4, None), (5, ["clean", None]), (6, ["scam", "topic_crypto"])]
    df = spark.createDataFrame(rows, "k int, labels array<string>")
    got = {r.k: r.labels for r in training.without_labels(df, "labels", ["promo"]).collect()}
    assert got == {1: ["scam"], 5: ["clean"], 6: ["scam", "topic_crypto"]}
    assert training.without_labels(df.limit(0), "labels", ["promo"]).count() == 0
    single = spark.createDataFrame([(1, "scam"), (2, None), (3, "promo")], "k int, label string")
    assert {r.k: r.label for r in training.without_labels(single, "label", ["promo"]).collect()} == {1: ["scam"]}


def test_stages_are_models_of_their_own(spark):
    kinds = [("free prize claim", ["scam"]), ("coin chain token", ["topic_crypto"]), ("coin prize claim", ["scam", "topic_crypto"]), ("tea and bread", ["clean"]), ("coin promo", ["promo"])]
    df = spark.createDataFrame([(k, *kinds[k % 5]) for k in range(60)], "k int, text string, labels array<string>")
    out = training.score_two_stage(df, "text", training.train_two_stage(df, "text", "labels")).collect()
    for r in out:
        assert (r.p_scam > 0.5) == ("scam" in r.labels)
        assert (r.p_topic_crypto > 0.5) == ("topic_crypto" in r.labels)
        assert r.p_clean == 1 - max(r.p_scam, r.p_topic_crypto)
    trained = training.train_one_vs_rest(df, "text", "labels", excluded=["promo"])
    scored = training.score_posts(df, "text", trained).where("array_contains(labels, 'clean')").collect()
    assert all(r.p_clean > 0.5 for r in scored)
    path = shared_path(spark, "model")
    training.save_trained(trained, path)
    again = training.score_posts(df, "text", training.load_trained(spark, path))
    assert sorted(again.select("k", "p_scam", "p_clean").collect()) == sorted(training.score_posts(df, "text", trained).select("k", "p_scam", "p_clean").collect())
    meta = training.run_metadata(df, "labels", "r1", trained, ["promo"]).first()
    assert (meta.n_rows, meta.n_changed, meta.excluded) == (48, 12, ["promo"])
    assert sorted(meta.classes) == ["clean", "scam", "topic_crypto"]
    none = training.train_two_stage(df.where("array_contains(labels, 'clean')"), "text", "labels")
    assert {(r.p_scam, r.p_topic_crypto, r.p_clean) for r in training.score_two_stage(df, "text", none).collect()} == {(0.0, 0.0, 1.0)}


def test_macro_f1_decides_between_equals(spark):
    rows = [("a", "tree", 0.1, 0.8, 0.7, 0.5), ("b", "tree", 0.1, 0.8, 0.7, 0.6), ("c", "linear", 0.05, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "name string, model_type string, scam_fpr double, scam_recall double, micro_f1 double, macro_f1 double")
    assert {r.name: (r.place, r.place_in_kind) for r in thresholds.bakeoff_rank(df).collect()} == {"a": (3, 2), "b": (2, 1), "c": (1, 1)}
