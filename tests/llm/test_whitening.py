import math
import random

import numpy as np
from pyspark.sql import Row

from curatrix.llm import whitening


def brute(rows, count):
    """(id, component) -> (n, deviation, whitened, explained), by a library's eigenvectors."""
    good = [(i, [math.floor(1024 * c) + 100000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = len(good)
    sums = [sum(x[d] for _, x in good) for d in range(len(good[0][1]))]
    y = np.array([[x[d] - sums[d] / n for d in range(len(sums))] for _, x in good])
    v = y.T @ y / n
    e, c = np.linalg.eigh(v)
    e, c = e[::-1][:count], c[:, ::-1][:, :count]
    out = []
    for (i, x), row in zip(good, y, strict=True):
        deviation = sum((n * x[d] - sums[d]) ** 2 for d in range(len(sums)))
        out += [(i, k + 1, n, deviation, float(row @ c[:, k] / math.sqrt(e[k])), e[k] / np.trace(v)) for k in range(len(e))]
    return out


def same(got, want):
    assert len(got) == len(want)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))
    got, want = order(got), order(want)
    signs: dict[int, float] = {}
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4]
        if abs(b[4]) > 1e-6:
            assert signs.setdefault(b[1], math.copysign(1, a[4] * b[4])) == math.copysign(1, a[4] * b[4])
        assert math.isclose(abs(a[4]), abs(b[4]), rel_tol=1e-7, abs_tol=1e-7)
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
        assert a[6] < 1e-6


def opened(df):
    rows = whitening.by_component(df).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    return [tuple(r) for r in rows.collect()]


def test_solver_equals_library_on_hard_matrices():
    rng = np.random.default_rng(0)
    for t in range(240):
        d, kind = int(rng.integers(1, 40)), t % 6
        a = rng.standard_normal((d, d))
        q = np.linalg.qr(a)[0]
        m = [
            lambda: a @ a.T,
            lambda: q @ np.diag(np.r_[np.ones(d // 2 + 1) * 5, rng.random(d)][:d]) @ q.T,  # half of the eigenvalues are equal
            lambda: np.diag(rng.integers(0, 4, d).astype(float)),  # falls apart, with ties
            lambda: a[:, : max(1, d // 3)] @ a[:, : max(1, d // 3)].T,  # rank of a third
            lambda: np.eye(d) * 7,
            lambda: q @ np.diag(10.0 ** -np.arange(d)) @ q.T * 1e9,
        ][kind]()
        m = (m + m.T) / 2
        values, vectors = whitening.components(m, 8)
        want = np.linalg.eigvalsh(m)[::-1][:8]
        k = len(values)
        assert (want > 1e-10 * want[0]).sum() <= k <= max(0, (want > 1e-14 * want[0]).sum())
        if k:
            assert np.abs(values - want[:k]).max() < 1e-13 * want[0]
            assert np.abs(m @ vectors - vectors * values).max() < 1e-12 * want[0]
            assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(12), rng.standard_normal(11)
    b[4] = 0.0
    values = np.linalg.eigvalsh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
    at = rng.standard_normal(40) * 2
    assert whitening.count_below(a, b, at).tolist() == [(values < x).sum() for x in at]


def test_equals_brute_force_with_bad_rows_repeats_and_clashing_names(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 3 - j / 2) + (5000 if j == 0 else 0) for j in range(5)]) for k in range(200)]
    rows += [(7, rows[7][1]), (7, [1.0] * 5), (None, [0.5] * 5), (300, None), (301, [None] * 5), (302, [float("nan")] + [0.0] * 4), (303, [float("inf")] + [0.0] * 4)]
    df = spark.createDataFrame([Row(vec_id=i, embedding=v, whitened="x", n="y", id="z", vec=1) for i, v in rows], "vec_id long, embedding array<double>, whitened string, n string, id string, vec int")
    same(opened(whitening.whiten(df, count=3)), brute(rows, 3))
    same(opened(whitening.whiten(df.repartition(7), count=8)), brute(rows, 8))  # five components are all there are


def test_degenerate_tables(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)], [(1, []), (2, [])]):
        assert opened(whitening.whiten(spark.createDataFrame(rows, kind))) == []
    # one dimension varies; vectors of unlike length are filled up with 0
    rows = [(1, [1.0, 4.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0])]
    same(opened(whitening.whiten(spark.createDataFrame(rows, kind))), [r for r in brute(rows, 1)])
    short = spark.createDataFrame([(1, [1.0]), (2, [3.0, 4.0]), (3, [2.0, 1.0])], kind)
    same(opened(whitening.whiten(short)), brute([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [2.0, 1.0])], 2))


def test_sums_beyond_64_bits_are_exact(spark):
    big = float(1 << 32)  # x near 2^44, n * x - S squared near 2^98
    rows = [(k, [big * (k % 5), 1.0]) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(df).collect()} == {None, 0}  # 0: rows in the middle
    n, total = whitening.sums(whitening.usable(df, "vec_id", "embedding"), 2, 1024, 100000)
    assert (n, total) == (50, [sum(math.floor(1024 * v[d]) + 100000 for _, v in rows) for d in range(2)])


def test_query(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.op13_whitening(spark, sf_dir).collect()]
    same(got, brute(rows, 8))
