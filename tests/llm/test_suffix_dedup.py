import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from curatrix.llm import suffix_dedup


def brute(rows, window):
    data = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(d[k : k + window] for _, d in data for k in range(len(d) - window + 1))
    out = []
    for i, d in data:
        covered = [False] * len(d)
        for k in range(len(d) - window + 1):
            if counts[d[k : k + window]] > 1:
                covered[k : k + window] = [True] * window
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        kept = bytes(b for b, c in zip(d, covered, strict=True) if not c)
        out.append((i, len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, window=400, partitions=5, shorter=None):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = suffix_dedup.without_repeats(df, window, shorter).collect()
    if shorter:
        assert sorted(((r.doc_id, r.n_bytes, r.n_repeated) for r in got), key=str) == sorted((r[:3] for r in brute(rows, shorter)), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got), key=str) == brute(rows, window)


def words(rng, n):
    return " ".join(rng.choice(("alpha", "beta", "gämma", "delta", "x", "yy")) + str(rng.randrange(50)) for _ in range(n))


@pytest.mark.parametrize("hot", [64, 3])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(hot)
    passages = [words(rng, n) for n in (40, 55, 60, 70, 90, 200)]
    texts = []
    for _ in range(120):
        parts = [words(rng, rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages)[rng.randrange(20) :], words(rng, rng.randrange(60))]
        texts.append(" ".join(parts))
    texts += texts[:10] + [t[:-7] for t in texts[10:20]] + [t[:500] + "#" + t[500:] for t in texts[20:40]]
    check(spark, list(enumerate(texts)))
    check(spark, list(enumerate(texts)), shorter=250)


def test_edge_cases(spark):
    rng = random.Random(9)
    long = words(rng, 12_000)
    rows = [(0, None), (1, ""), (2, "a" * 399), (3, "a" * 399), (4, "b" * 400), (5, "b" * 401), (6, "c" * 5000), (7, "d" * 400), (8, "e" * 400), (9, "e" * 400),
            (9, "e" * 400), (None, "f" * 450), (None, "f" * 450), (10, "é" * 250), (11, "xyz" * 300)]
    check(spark, rows)
    check(spark, [(1, long[:60_000]), (2, long[30_000:61_000])])
    check(spark, rows, shorter=250)
    empty = spark.createDataFrame([], "doc_id long, text string, did string")
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_chunks_of_very_long_texts(monkeypatch):
    rng = random.Random(2)
    data = words(rng, 3000).encode()
    texts = [b"short", data, data[:5000], b"", data[300:700]]
    whole = suffix_dedup.spans_of(texts, 400, 128)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 1000)
    parts = suffix_dedup.spans_of(texts, 400, 128)
    anchor = lambda spans: {(number, start + k): (key, start + at) for number, key, _, _, start, n, at in np.array(spans).T.tolist() for k in range(n)}
    assert anchor(whole) == anchor(parts) and len(anchor(whole)) == len(data) - 399 + 5000 - 399 + 1


def test_query_tells_passages_of_over_fifty_words(spark, tmp_path):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"{rng.randrange(16**5):05x}" for _ in range(n))
    passage = fresh(51)  # 305 bytes
    texts = [f"{fresh(30)} {passage} {fresh(30)}" if k % 3 == 0 else fresh(90) for k in range(30)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    least = len(passage.encode())
    assert {i for i, r in got.items() if r.n_repeated} == set(range(0, 30, 3)) and all(least <= got[i].n_repeated < least + 20 for i in range(0, 30, 3))
    # what is removed is the contract's: repeats of 400 bytes
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.values()), key=str) == brute(list(enumerate(texts)), 400)
    assert not any(r.n_removed for r in got.values())
