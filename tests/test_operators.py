"""Operators against plain Python on small rows, and arithmetic that is known."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from curatrix.functions import text as X
from curatrix.operators import counts, metrics, pages, splits, thresholds, training
from curatrix.plans.ranking import hash_bucket, hash_key, ranked


def test_clean_text(spark):
    rows = [(None,), ("",), (" Ａ​b　c ",), ("see HTTPS://X.y/z www.a.b ok",), ("x\x1cy z",)]
    df = spark.createDataFrame(rows, "t string")
    out = [r[0] for r in df.select(X.clean_text(F.col("t"), strip_urls=True, ignore_case=True)).collect()]
    assert out == ["", "", "ab c", "see ok", "x y z"]


def test_rank_is_global_for_any_partitioning(spark):
    df = spark.range(2000).withColumn("k", hash_key(F.col("id"), 7))
    want = {r.id: n for n, r in enumerate(sorted(df.collect(), key=lambda r: (r.k, r.id)))}
    for n in (1, 4, 50):
        out = ranked(df.repartition(n), hash_bucket(F.col("k")), ["k", "id"])
        assert {r.id: r.rank for r in out.collect()} == want


def test_split_sizes(spark):
    df = spark.range(2619).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") * 977).alias("at"))
    got = {r["split"]: r["count"] for r in splits.time_split_3way(df, "at", "id", 0.1, 0.1).groupBy("split").count().collect()}
    assert got == {"train": 2097, "calib": 261, "holdout": 261}
    one = spark.createDataFrame([(4277,)], "n int").withColumn("g", F.lit("a"))
    quotas = {r["split"]: r.quota for r in splits.largest_remainder(one, "n", [("train", 0.6), ("valid", 0.1), ("calib", 0.05), ("holdout", 0.25)], ["g"]).collect()}
    assert sum(quotas.values()) == 4277 and quotas["train"] == 2566 and quotas["holdout"] == 1069


def test_thresholds_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0.1, 0.2, 0.35, 0.5, 0.77, 0.9, rng.random()]), rng.random() < 0.3) for _ in range(400)]
    df = spark.createDataFrame([Row(s=s, y=y) for s, y in rows])
    pos, neg = sum(y for _, y in rows), sum(not y for _, y in rows)
    for target in (0.0, 0.02, 0.2, 1.0):
        best = max((sum(y for s, y in rows if s >= t), t) for t in {1.0, *(s for s, _ in rows)} if sum(not y for s, y in rows if s >= t) / neg <= target)
        got = thresholds.tune_fpr(df, [], "s", F.col("y"), F.lit(target)).first()
        assert got.threshold == best[1] and abs(got.recall - best[0] / pos) < 1e-12
    points, area, last = [], 0.0, (0.0, 0.0)
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp, k = sum(y for t, y in rows if t >= s), sum(t >= s for t, _ in rows)
        points.append((tp / pos, tp / k))
    for r, p in points:
        area += (r - last[0]) * (p + last[1]) / 2
        last = (r, p)
    assert abs(metrics.pr_auc(df, "s", F.col("y")).first()[0] - area) < 1e-12


def test_merge_equals_fold(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), k, [rng.choice("xyz") for _ in range(rng.randrange(3))], rng.choice([None, "", " n", "note", "longer note"]), rng.choice(["t", "text", "texts"]), rng.choice([None, "2024-01-02", "2024-01-01"]), rng.choice([None, " ", "p", "q"])) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, line long, labels array<string>, notes string, text string, at string, src string")
    got = {r.id: r for r in counts.merge_duplicates(df, ["labels", "text", "notes", "at", "src"], ["labels"], ["notes", "text"], "at", ["src"]).collect() if r.id}
    for key in "abc":
        own = [r for r in rows if r[0] == key]
        rich = lambda r: (bool(r[2]) + sum(bool((v or "").strip()) for v in r[3:]), len(r[2]), len((r[3] or "").strip()), len((r[4] or "").strip()), -r[1])
        canonical = max(own, key=rich)
        order = [canonical, *(r for r in own if r is not canonical)]
        labels = list(dict.fromkeys(x for r in order for x in r[2]))
        text = canonical[4]
        for r in order[1:]:
            text = r[4] if len(r[4].strip()) > len(text.strip()) else text
        assert (got[key].labels, got[key].text, got[key].line, got[key].merged) == (labels, text, min(r[1] for r in own), len(own))
        assert got[key].at == min((r[5] for r in own if r[5]), default=None)
        assert got[key].src == next((r[6] for r in order if r[6] and r[6].strip()), None)


def test_page_blocks():
    html = "<p>" + "a" * 25 + "</p><script>" + "b" * 30 + "</script><pre>" + "c" * 30 + "</pre><div contenteditable>" + "d" * 30 + "<b>" + "e" * 30 + "</b></div><p>short</p><p>f&amp;" + "f" * 30
    assert pages.blocks_of(html) == ["a" * 25, "f&" + "f" * 30]
    assert pages.blocks_of(None) == []


def test_pieces():
    vocabulary = {"un", "##known", "##kn", "known", "a"}
    assert training.pieces_of("unknown", vocabulary) == ["un", "##known"]
    assert training.pieces_of("unknows", vocabulary) == ["[UNK]"] and training.pieces_of("a" * 101, vocabulary) == ["[UNK]"]
