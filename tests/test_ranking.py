"""Ranks, running sums, merged and repeated rows where one value holds most of the rows."""

import random

from pyspark.sql import functions as F

from curatrix.operators import counts, metrics, splits, validation
from curatrix.plans.ranking import ranked, running_sums


def test_running_sums_with_crowded_and_null_values(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 0.0, 0.0, 1.0, rng.random()]), k, rng.randrange(5)) for k in range(700)]
    out = running_sums(spark.createDataFrame(rows, "g string, s double, k long, v long"), ["g"], [F.desc("s"), "k"], {"total": F.col("v")})
    want, sums = {}, {}
    for g, s, k, v in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        want[k] = sums[g] = sums.get(g, 0) + v
    assert {r.k: r.total for r in out.collect()} == want
    assert running_sums(out.where("false").drop("total"), ["g"], ["k"], {"total": F.col("v")}).count() == 0


def test_ranks_without_keys(spark):
    rows = [(k * 7919 % 1000,) for k in range(1000)]
    assert all(r.rank == r.k for r in ranked(spark.createDataFrame(rows, "k long"), ["k"]).collect())


def test_rows_without_a_time_are_the_first(spark):
    rows = [(k, None if k % 3 else f"2024-01-{1 + k % 28:02d} 00:00:00") for k in range(300)]
    df = spark.createDataFrame(rows, "k long, at string").withColumn("at", F.to_timestamp("at"))
    got = {r.k: r.split for r in splits.time_holdout(df, "at", "k", ratio=0.25).collect()}
    order = sorted(rows, key=lambda r: (r[1] or "2024-01-01 00:00:00", r[0]))
    assert got == {k: "train" if place < 225 else "holdout" for place, (k, _) in enumerate(order)}


def test_pr_auc_equals_trapezoids(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 1.0, rng.random()]), rng.random() < 0.3) for _ in range(400)]
    got = metrics.pr_auc(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y"), 1.0).collect()[0].pr_auc
    area, last, total = 0.0, (0.0, 1.0), sum(y for _, y in rows)
    for s in sorted({s for s, _ in rows}, reverse=True):
        above = [y for t, y in rows if t >= s]
        point = (sum(above) / total, sum(above) / len(above))
        area += (point[0] - last[0]) * (point[1] + last[1]) / 2
        last = point
    assert abs(got - area) < 1e-12


def test_merged_rows_of_a_hot_id(spark):
    rng = random.Random(3)
    texts = [None, "", " a", "bb", "cc ", "dddd", "eeee"]
    rows = [
        (rng.choice(["hot", "hot", "hot", "x", None]), k, rng.choice([None, [], ["p"], ["q", "p"], ["r", "q"]]), rng.choice(texts), rng.choice(["2024", "2023", None]), rng.choice([None, "", "m", "n"]))
        for k in range(60)
    ]
    schema = "id string, line long, labels array<string>, text string, at string, source string"
    out = counts.merge_duplicates(spark.createDataFrame(rows, schema), ["labels", "text", "source"], ["labels"], ["text"], "at", ["source"])
    got = {r.id: r for r in out.where("id is not null").collect()}
    assert out.where("id is null and merged = 1").count() == sum(r[0] is None for r in rows)
    size = lambda t: len((t or "").strip())
    for key in ("hot", "x"):
        group = [r for r in rows if r[0] == key]
        rich = lambda r: (bool(r[2]) + (size(r[3]) > 0) + (size(r[5]) > 0), len(r[2] or []), size(r[3]), -r[1])
        best = max(group, key=rich)
        ordered = [best, *[r for r in group if r is not best]]
        labels = list(dict.fromkeys(x for r in ordered for x in r[2] or []))
        text = best[3]
        for r in ordered:
            text = r[3] if size(r[3]) > size(text) else text
        source = next((r[5] for r in ordered if size(r[5])), None)
        want = (labels, text, min(r[4] for r in group if r[4]), source, min(r[1] for r in group), len(group))
        assert (got[key].labels, got[key].text, got[key]["at"], got[key].source, got[key].line, got[key].merged) == want


def test_repeated_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "line long, id string")
    assert {r.line: r.repeated for r in validation.with_repeated(rows, "id").collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_changes_in_file_order(spark, tmp_path):
    from curatrix.sources.files import read_change_list

    labels = " ".join(f"l{k}" for k in range(1500))
    (tmp_path / "a.txt").write_text("1 scam\n2 " + labels + "\n1 promo\n")
    (tmp_path / "b.txt").write_text("1 clean\n# 1 scam\n")
    got = {r.id: r.new_labels for r in read_change_list(spark, str(tmp_path)).collect()}
    assert got["1"] == ["clean"] and len(got["2"]) == 1500
