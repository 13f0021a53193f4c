import math
import random

from pyspark.sql import Row

from curatrix.llm import topk
from curatrix.llm.topk import op7_topk


def brute(rows, queries, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = [(i, [math.floor(256 * x) for x in v]) for i, v in queries if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in asked:
        found = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), j) for j, c in good if j != i)[:k]
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    return sorted(out)


def test_equals_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.0, -0.5, 0.25, 0.003, 1.0]) for _ in range(6)]) for k in range(120)]
    rows += [(7, rows[7][1]), (7, [1.0] * 6), (200, None), (201, [None] * 6), (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (204, []), (205, [1.0, 1.0]), (206, [1e6] * 6)]
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, score="x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    queries = [r for r in rows if r[0] is not None and r[0] % 5 == 0] + [rows[7], (7, [1.0] * 6)]
    asked = spark.createDataFrame([Row(vec_id=i, embedding=v) for i, v in queries], "vec_id long, embedding array<double>")
    for size in (1000, 7):
        got = sorted(tuple(r) for r in topk.top_k(df, asked, 4, query_rows=size, shard_rows=size).collect())
        assert got == brute(rows, queries, 4)
    assert topk.top_k(df.limit(0), asked.limit(0), 4).count() == 0
    assert topk.top_k(df, asked.limit(0), 4).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op7_topk(spark, sf_dir).collect()) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
