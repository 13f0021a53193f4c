"""Exact top-k inner-product search by tiles.

Candidates are packed into shards, queries into blocks, each as one row that holds a matrix. Every (block, shard) tile is
one row of an equi-join on the block's number: it is multiplied out, each query keeps its best k of the tile, and the
short lists are merged, first within groups of shards, then for the query. Block and shard sizes are bounds on rows, so
that a tile's memory doesn't depend on the input.

Components become floor(scale * x), x as double; scores are exact integers (float products are used only where no sum
can leave the range of exact integers, else integer products). Vectors that are null or hold a null or non-finite
component take no part, neither do rows with a null id. Only the id and the vector are read, so further columns of any name
do no harm; empty tables give no rows. Vectors of unlike length are compared on the components that both
have. A candidate with the query's own id is never a result. Ties go to the smaller id; repeated rows each take a rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import staged, table, trimmed

_MATRIX = "block int, ids binary, width int, cells binary"
#: Components are held to this range; scores beyond 64 bits wrap around, as longs do.
_LARGEST = float(1 << 62)
#: Integers up to here are exact as doubles.
_EXACT = float(1 << 53)
#: Query matrices of up to so many bytes are sent to all tasks; groups of shards by which tiles are dealt out and merged.
QUERY_BYTES, PARTS = 16 << 20, 64


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(F.coalesce(finite, F.lit(False)))


def packed(rows: DataFrame, scale: int, block_rows: int) -> DataFrame:
    """Matrices of about block_rows vectors of a task, as integers; block is the task's partition."""

    def emit(ids: list[np.ndarray], vecs: list[np.ndarray]) -> pa.RecordBatch:
        width = max(v.shape[1] for v in vecs)
        cells = np.zeros((sum(len(v) for v in vecs), width), np.int64)
        at = 0
        for v in vecs:
            cells[at : at + len(v), : v.shape[1]] = v
            at += len(v)
        return pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([cells.tobytes()], pa.binary())],
            names=["block", "ids", "width", "cells"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vecs, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                lists = part.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                flat = np.clip(np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -_LARGEST, _LARGEST).astype(np.int64)
                width = int(lengths.max(initial=0))
                cells = np.zeros((len(keys), width), np.int64)
                cells[np.arange(width) < lengths[:, None]] = flat
                ids.append(keys)
                vecs.append(cells)
                held += len(keys)
                if held >= block_rows:
                    yield emit(ids, vecs)
                    ids, vecs, held = [], [], 0
        if held:
            yield emit(ids, vecs)

    return rows.mapInArrow(trimmed(run), _MATRIX)


def tile_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    width = min(q.shape[1], c.shape[1])
    q, c = q[:, :width], c[:, :width]
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, width) < _EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row, ties to the smaller id, own ids left out. Columns come in order of ids."""
    worst = np.iinfo(np.int64).min
    scores = np.where(ids[None, :] == own[:, None], worst, scores)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        above, equal = scores > least[:, None], scores == least[:, None]
        room = k - above.sum(axis=1)
        take = above | (equal & (np.cumsum(equal, axis=1) <= room[:, None]))
    else:
        take = np.ones(scores.shape, bool)
    take &= ids[None, :] != own[:, None]
    return np.nonzero(take)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
          query_rows: int = 1024, shard_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors for each row of queries, exact. No usable rows: no result rows."""
    asked = usable(queries, key, vector)
    blocks = max(1, math.ceil(asked.count() / query_rows))
    # round robin spreads the queries evenly, repeated ids included
    asked = staged(packed(asked.repartition(blocks), scale, 2 * query_rows), "topk-queries")
    shards = packed(usable(vectors, key, vector), scale, shard_rows).select(F.col("ids").alias("c_ids"), F.col("width").alias("c_width"), F.col("cells").alias("c_cells"))
    spread = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.pmod(F.xxhash64("c_ids"), F.lit(PARTS)))
    held = asked.agg(F.sum(F.octet_length("cells") + F.octet_length("ids"))).first()[0] or 0
    if held <= QUERY_BYTES:
        tiles = spread.join(F.broadcast(asked), "block")
    else:  # each block goes to PARTS tasks, so that its shards are not all in one
        tiles = spread.join(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).cast("long")), ["block", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_width, q, c_ids, c_width, c, part, block = (batch.column(j)[row].as_py() for j in range(8))
                q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                q, c = np.frombuffer(q, np.int64).reshape(len(q_ids), q_width), np.frombuffer(c, np.int64).reshape(len(c_ids), c_width)
                order = np.argsort(c_ids, kind="stable")
                c_ids, c = c_ids[order], c[order]
                for at in range(0, len(q_ids), 256):
                    scores = tile_scores(q[at : at + 256], c)
                    i, j = best(scores, c_ids, q_ids[at : at + 256], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[at + i]), pa.array(np.full(len(i), block, np.int64)), pa.array(at + i, pa.int64()), pa.array(np.full(len(i), part, np.int64)), pa.array(c_ids[j]), pa.array(scores[i, j])],
                        names=["query_id", "block", "row", "part", "vec_id", "score"],
                    )

    found = tiles.select("ids", "width", "cells", "c_ids", "c_width", "c_cells", "part", "block").mapInArrow(trimmed(run), "query_id long, block long, row long, part long, vec_id long, score long")

    def merged(df: DataFrame, *by: str) -> DataFrame:
        order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("lower"), "vec_id")))
        return df.groupBy(*by).agg(F.slice(order, 1, k).alias("best"))

    def opened(df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, F.posexplode("best").alias("at", "b")).select(*keep, (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.lower")).alias("score"))

    query = ["query_id", "block", "row"]  # repeated query rows keep lists of their own
    groups = opened(merged(found, *query, "part"), *query)
    return opened(merged(groups, *query), "query_id").select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP7_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
