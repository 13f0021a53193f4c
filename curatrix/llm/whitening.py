"""Whitening of embeddings: leading components of their covariance, and each vector's place along them.

Spark sums up counts, per-dimension sums and the centred covariance, each task over its own rows. The driver holds matrices
of dimension x dimension only: it makes the covariance tridiagonal by Householder reflections, finds the leading eigenvalues
by bisection on Sturm counts, and their vectors by inverse iteration, where those of eigenvalues that are close together are
made orthogonal to each other. The components go to the tasks, dimension x count numbers, and each row is projected on them.

Entries become x = floor(scale * c) + shift, as long integers. All sums of x are exact. Rows whose vector is null or holds null
or non-finite entries take no part, those with a null id do. Entries beyond +-2^45 / scale are held there. Vectors of unlike
length are filled up to the longest with entries of 0. A component whose eigenvalue is nothing beside the
largest (RANK_EPS: constant dimensions, copies of one vector, fewer rows than components) can't be scaled to 1: it gives no rows. Empty tables, or tables
of empty vectors only, give none either. Repeated rows each get theirs. Only the id and the vector are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import staged, table, trimmed

SCALE, SHIFT = 1024, 100000
#: Entries are held to this range, so that sums of their squares stay in range of doubles with room to spare.
_LARGEST = float(1 << 45)
#: Eigenvalues below this share of the largest are rounding.
RANK_EPS = 1e-12
#: Eigenvalues closer than this share of the matrix' norm are one cluster.
CLUSTER_GAP = 1e-3
#: Rows that are multiplied at once.
CHUNK_ROWS = 4096


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec")).where(F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)))


def entries(lists: pa.Array, width: int, scale: int, shift: int) -> np.ndarray:
    """Rows x width matrix of x, as long integers."""
    ends = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    x = np.full((len(ends), width), shift, np.int64)
    x[np.arange(width) < ends[:, None]] = np.clip(flat, -_LARGEST, _LARGEST).astype(np.int64) + shift
    return x


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            part = batch.slice(at, CHUNK_ROWS)
            yield part, part.column(column)


def sums(rows: DataFrame, width: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sums of x by dimension: each task sends one row for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for _, lists in chunks(batches, 0):
            x = entries(lists, width, scale, shift)
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(axis=0)  # two halves, so that no sum of a task can overflow
            high += (x >> 32).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(low), pa.array(high)], names=["dim", "n", "low", "high"])

    parts = rows.select("vec").mapInArrow(trimmed(run), "dim long, n long, low long, high long")
    exact = lambda name: F.sum(F.col(name).cast("decimal(38,0)")).alias(name)
    found = {r["dim"]: r for r in parts.groupBy("dim").agg(F.sum("n").alias("n"), exact("low"), exact("high")).collect()}  # a row for each dimension
    return int(found[0]["n"]) if found else 0, [(int(found[d]["high"]) << 32) + int(found[d]["low"]) for d in range(width)] if found else []


def covariance(rows: DataFrame, n: int, total: list[int], scale: int, shift: int) -> np.ndarray:
    """Sum of (x - S/n)(x - S/n)' over n: each task multiplies its rows, centred, and sends its matrix by rows."""
    width = len(total)
    base, rest = centre(n, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, any_row = np.zeros((width, width)), False
        for _, lists in chunks(batches, 0):
            y = (entries(lists, width, scale, shift) - base) - rest
            held += y.T @ y
            any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(held.ravel())], names=["i", "j", "v"])

    parts = rows.select("vec").mapInArrow(trimmed(run), "i long, j long, v double").where("i <= j")
    out = np.zeros((width, width))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas().itertuples(index=False):  # dimension x dimension numbers
        out[i, j] = out[j, i] = v / n
    return out


def centre(n: int, total: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """S/n as a whole number and the rest of it: x - S/n is then right to the last bit, however far x is from 0."""
    return np.array([s // n for s in total], np.int64), np.array([(s % n) / n for s in total])


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a symmetric matrix, and the unit vectors of the Householder reflections that lead there."""
    a = np.array(matrix, np.float64)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        v, size = x.copy(), np.sqrt(x @ x)
        v[0] += np.copysign(size, x[0])
        length = np.sqrt(v @ v)
        v = v / length if length > 0 else v
        reflections.append(v)
        if length > 0:
            block = a[k + 1 :, k + 1 :]
            p = 2 * (block @ v)
            w = p - (p @ v) * v
            block -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] = a[k, k + 1 :] = 0.0
            a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0]) if size > 0 else 0.0
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def reflected(y: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """The vector of the matrix that belongs to the vector y of its tridiagonal form."""
    y = y.copy()
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        y[k + 1 :] -= 2 * (v @ y[k + 1 :]) * v
    return y


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each number in `at`, how many eigenvalues are less: the negative terms of the Sturm sequence."""
    square = off * off
    tiny = np.finfo(float).tiny / np.finfo(float).eps * max(1.0, float(square.max(initial=0.0)))
    q = diagonal[0] - at
    below = (q < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diagonal[k] - at - square[k - 1] / q
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The `count` largest eigenvalues, falling, each cornered by halving an interval until it is one rounding wide."""
    d = len(diagonal)
    reach = np.abs(np.append(off, 0.0)) + np.abs(np.insert(off, 0, 0.0)) if d > 1 else np.zeros(1)
    low, high = np.full(count, (diagonal - reach).min()), np.full(count, (diagonal + reach).max())
    span = max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - 1e-12 * span, high + 1e-12 * span
    wanted = d - 1 - np.arange(count)  # eigenvalues that lie below the one sought
    for _ in range(2000):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        above = count_below(diagonal, off, middle) > wanted
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return low + (high - low) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """The solution of (T - shift) y = right, by elimination with row exchanges; pivots under `least` count as `least`."""
    d = len(diagonal)
    main, upper, second = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    y = right.astype(np.float64).copy()
    for k in range(d - 1):
        below = off[k]
        if abs(below) > abs(main[k]):  # the next row comes first
            factor = main[k] / below
            main[k], main[k + 1], upper[k] = below, upper[k] - factor * main[k + 1], main[k + 1]
            if k + 1 < d - 1:
                second[k], upper[k + 1] = upper[k + 1], -factor * upper[k + 1]
            y[k], y[k + 1] = y[k + 1], y[k] - factor * y[k + 1]
        else:
            if abs(main[k]) < least:
                main[k] = least
            factor = below / main[k]
            main[k + 1] -= factor * upper[k]
            y[k + 1] -= factor * y[k]
    if abs(main[d - 1]) < least:
        main[d - 1] = least
    for k in range(d - 1, -1, -1):
        rest = y[k]
        if k + 1 < d:
            rest -= upper[k] * y[k + 1]
        if k + 2 < d:
            rest -= second[k] * y[k + 2]
        y[k] = rest / main[k]
    return y


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the values, as columns, by inverse iteration; those of one cluster are made orthogonal in each step."""
    d = len(diagonal)
    norm = max(float(np.abs(diagonal).max(initial=0.0)), float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    eps = np.finfo(float).eps * norm
    out = np.zeros((d, len(values)))
    begin, used = 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER_GAP * norm:
            begin = k
        # equal values would give equal vectors: each of a cluster is solved a little lower
        used = value if k == begin else min(value, used - 4 * eps)
        y = np.random.default_rng(k).standard_normal(d)
        for _ in range(6):
            y = solved(diagonal, off, used, y / np.abs(y).max(), eps)
            for _ in range(2):
                y = y - out[:, begin:k] @ (out[:, begin:k].T @ (y / np.abs(y).max())) * np.abs(y).max()
            y = y / np.sqrt(y @ y)
        out[:, k] = y
    return out


def components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a symmetric matrix and their unit vectors as columns, largest entry positive; those of no weight are left out."""
    scale = float(np.abs(matrix).max(initial=0.0))
    count = min(count, len(matrix))
    if not count or scale == 0.0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, count)
    values = values[values > RANK_EPS * max(values[0], 0.0)] if values[0] > 0 else values[:0]
    vectors = leading_vectors(diagonal, off, values)
    out = np.stack([reflected(vectors[:, k], reflections) for k in range(len(values))], axis=1) if len(values) else np.zeros((len(matrix), 0))
    signs = np.sign(out[np.abs(out).argmax(axis=0), np.arange(out.shape[1])])
    return values * scale, out * signs


def fitted(vectors: DataFrame, count: int, scale: int, shift: int) -> tuple[int, list[int], np.ndarray, np.ndarray, float]:
    """(n, S, eigenvalues, components, trace) of usable rows (id, vec)."""
    width = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    n, total = sums(vectors, width, scale, shift) if width else (0, [])
    if not n:
        return 0, [], np.zeros(0), np.zeros((0, 0)), 0.0
    matrix = covariance(vectors, n, total, scale, shift)
    return n, total, *components(matrix, count), float(np.trace(matrix))


def whiten(vectors: DataFrame, count: int = 8, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, n, deviation, whitened array, explained array, identity_error) of each usable row; deviation is null where a long can't hold it."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows = usable(vectors, key, vector)
    n, total, values, vecs, trace = fitted(rows, count, scale, shift)
    schema = f"id {kind}, n long, deviation long, whitened array<double>"
    if not len(values):
        empty = spark.createDataFrame([], schema)
        return empty.select(F.col("id").alias(key), "n", "deviation", "whitened", F.array().cast("array<double>").alias("explained"), F.lit(None).cast("double").alias("identity_error"))
    width = len(total)
    base, rest = centre(n, total)
    rests = np.array([s % n for s in total], np.int64)
    project = vecs / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lists in chunks(batches, 1):
            y = entries(lists, width, scale, shift) - base
            z = (y - rest) @ project
            away = np.abs(y).max(axis=1, initial=0).astype(np.float64) + 1
            if float(away.max(initial=0.0) * n) ** 2 * width < float(1 << 62):
                off = n * y - rests  # n * x - S
                deviation = (off * off).sum(axis=1).tolist()
            else:  # beyond long arithmetic in between, maybe not in the end
                exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rests, strict=True)) for row in y]
                deviation = [v if v < 1 << 63 else None for v in exact]
            ends = pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.full(len(y), n)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=["id", "n", "deviation", "whitened"]
            )

    out = staged(rows.mapInArrow(trimmed(run), schema), "whitened")
    error = identity_error(out, n, len(values))
    shares = F.array(*[F.lit(float(v / trace)) for v in values])
    return out.select(F.col("id").alias(key), "n", "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(whitened: DataFrame, n: int, count: int) -> float:
    """Largest entry of the whitened rows' covariance less the identity; one pass for the means, one for the products of what is centred."""
    at = lambda k: F.col("whitened")[k]
    means = whitened.agg(*[F.avg(at(k)) for k in range(count)]).first()
    cells = [(i, j) for i in range(count) for j in range(i, count)]
    off: list[Column] = [at(k) - F.lit(means[k]) for k in range(count)]
    found = whitened.agg(*[F.sum(off[i] * off[j]) for i, j in cells]).first()
    return float(max(abs(v / n - (i == j)) for (i, j), v in zip(cells, found, strict=True)))


def by_component(whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return whitened.select(key, "n", "deviation", "identity_error", pairs).select(
        key, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whiten(table(spark, sf_dir, "embeddings"), count=8))
