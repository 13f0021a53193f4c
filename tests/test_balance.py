"""Balanced samples: sizes against a search over all, shares within bands, and weights against loops."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curatrix.operators import balance as B


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 25), st.integers(0, 25), st.integers(0, 40), st.sampled_from([B.Bands(), B.EVALUATION, B.Bands((0.5, 0.6), (0.1, 0.9))]))
def test_sizes_lie_in_the_bands_and_are_nearly_the_largest(p, h, e, bands):
    def fits(a, b, c, slack=0.0):
        clean, whole = b + c, a + b + c
        if p and h + e and not bands.clean[0] * whole - slack - 1e-6 <= clean <= bands.clean[1] * whole + slack + 1e-6:
            return False
        return not (bands.hard and h and e) or bands.hard[0] * clean - slack - 1e-6 <= b <= bands.hard[1] * clean + slack + 1e-6

    got = B.sizes(p, h, e, bands)
    assert 0 <= got[0] <= p and 0 <= got[1] <= h and 0 <= got[2] <= e
    assert fits(*got, slack=1.0)  # whole rows
    best = max(a + b + c for a in range(p + 1) for b in range(h + 1) for c in range(e + 1) if fits(a, b, c))
    assert sum(got) >= best - 4


def posts(spark, n=12_000):
    draw = random.Random(11)
    rows = []
    for k in range(n):
        labels = [x for x, p in (("scam", 0.3), ("topic", 0.2), ("rare", 0.004), ("odd", 0.01)) if draw.random() < p]
        rows.append((k, labels or ([] if k % 2 else ["clean", None]), draw.random() < 0.05))
    return rows, spark.createDataFrame(rows, "k int, labels array<string>, flagged boolean")


def test_a_sample_is_within_all_bands(spark):
    rows, df = posts(spark)
    out = B.balanced_sample(df, "labels", F.col("flagged"), "k").collect()
    assert len({r.k for r in out}) == len(out)
    kinds = Counter(r.kind for r in out)
    clean = kinds["hard"] + kinds["easy"]
    assert 0.70 - 1e-3 <= clean / len(out) <= 0.85 + 1e-3 and 0.20 - 1e-3 <= kinds["hard"] / clean <= 0.40 + 1e-3
    named = Counter(x for r in out for x in r.labels if x not in ("clean", None))
    assert max(named.values()) <= 0.1 * len(out) * 1.01 + 8
    # a row's weight is the largest of its labels'; that of rare labels is the same for all that have them
    by = {}
    for r in out:
        by.setdefault(tuple(sorted(x for x in r.labels if x not in ("clean", None))), set()).add(r.weight)
    single = {s[0]: max(w) for s, w in by.items() if len(s) == 1}
    for s, w in by.items():
        assert len(w) == 1 or not s
        if s and all(x in single for x in s):
            assert abs(max(w) - max(single[x] for x in s)) < 2e-9
    have = Counter(tuple(sorted(x for x in labels if x not in ("clean", None))) for _, labels, _ in rows)
    got = Counter(tuple(sorted(x for x in r.labels if x not in ("clean", None))) for r in out)
    for s in have:
        if s:
            assert abs(got[s] - have[s] * max(by.get(s, {0}))) <= 1.001
    told = {r.bucket: r for r in B.shares(spark.createDataFrame(out), "labels", F.col("flagged")).collect()}
    assert told["clean"].n == clean and told["hard of clean"].n == kinds["hard"] and told["positive"].n == kinds["positive"] and told["commonest label"].n == max(named.values())
    assert told["clean"].share == clean / len(out)
    again = B.balanced_sample(df.repartition(13), "labels", F.col("flagged"), "k").collect()
    assert {r.k for r in again} == {r.k for r in out}


def test_odd_tables(spark):
    _, df = posts(spark, 300)
    null = df.withColumn("labels", F.lit(None).cast("array<string>"))
    assert B.balanced_sample(df.limit(0), "labels", F.col("flagged"), "k").count() == 0
    assert {r.status for r in B.shares(df.limit(0), "labels", F.col("flagged")).collect()} == {"ok", "below"}
    only = B.balanced_sample(null, "labels", F.lit(None).cast("boolean"), "k")
    assert [tuple(r) for r in only.groupBy("kind").count().collect()] == [("easy", 300)]
    twice = df.unionByName(df)
    assert B.balanced_sample(twice, "labels", F.col("flagged"), "k", B.EVALUATION).where("weight > 1 or weight <= 0").count() == 0
