"""Ranked lexical search: the best documents for each item, exact, by branch and bound over a document FP-tree.

One pass over the texts counts each document's terms and keeps, of those that items ask for, how often it has them: a
restricted term vector. Vectors are staged; counts over all documents give the terms' weights and their order, the most
frequent first. A task then reads its vectors in shards of a bounded size. Sorted by their terms in that order, vectors
that begin alike are neighbours: each shared beginning is a path of the trie, each subtree a run of neighbours. A subtree
carries for each of its terms the largest count in it, and the smallest length factor m: together an upper bound on the
score of any document in it. Items walk down depth first, best branch first, and an item leaves a branch as soon as its bound
is under the item's k-th best score so far. All items of a group take a step at once; each has a bound and a threshold of its own.
Tasks send k rows an item at most, which are merged first by groups of tasks and then by item.

Items are taken in blocks of ITEM_BYTES of text; only a block's items, terms and weights go to the tasks.

Results (terms, weights and scores are defined at `TERM` and in `found`): null texts have no term, nor do empty ones, and those count
nowhere; items without terms, and tables without documents, give no rows. Very long texts are counted whole. Repeated rows of documents
are documents of their own, repeated items get their rows each; with a null id a document comes last among equal
scores. Only ids and texts are read, so further columns of any name do no harm.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.llm.common import by_bytes, staged, table, trimmed

#: A term is a maximal match of this, A-Z lower-cased (fixed value): ASCII letters and digits, and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Text of items that is searched for in one pass; items that walk a tree together.
ITEM_BYTES, ITEM_GROUP = 1 << 20, 256
#: A shard has so many documents or entries of vectors at most (one document at least).
SHARD_ROWS, SHARD_ENTRIES = 8192, 2_000_000
#: Branches of up to so many documents are not split any more; small neighbours share a bucket of up to so many.
SMALL, BUCKET = 8, 16
#: Parts by which the tasks' lists are merged first.
PARTS = 64
_NO_ID = (1 << 63) - 1


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def restricted(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, counts) of each document with a term: n of all terms, the vector of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for whole in batches:
            for batch in by_bytes(whole):
                at, sizes, ends, found, counts = [], [], [0], [], []
                for k, value in enumerate(batch.column(1)):
                    own = terms(value.as_py() or "")
                    if own:
                        vector = Counter(map(known, own))
                        vector.pop(None, None)
                        at.append(k)
                        sizes.append(len(own))
                        found.extend(vector.keys())
                        counts.extend(vector.values())
                        ends.append(len(found))
                offsets = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (found, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(trimmed(run), "id long, n long, terms array<int>, counts array<int>")


@dataclass
class Items:
    """Items of a block: each one's distinct terms (by their place in the frequency order) and how often it has them, times the weight."""

    terms: list[np.ndarray]
    weights: list[np.ndarray]

    def groups(self, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, place of each term in the matrix or -1, matrix of terms by items)."""
        for start in range(0, len(self.terms), ITEM_GROUP):
            items = np.arange(start, min(start + ITEM_GROUP, len(self.terms)))
            used = np.unique(np.concatenate([self.terms[i] for i in items]))
            place = np.full(n_terms, -1, np.int64)
            place[used] = np.arange(len(used))
            # whole numbers below 2^53 are exact as doubles, and doubles multiply faster
            exact = max((int(self.weights[i].sum()) for i in items), default=0) * 1_000_000 < 1 << 53
            matrix = np.zeros((len(used), len(items)), np.float64 if exact else np.int64)
            for k, i in enumerate(items):
                matrix[place[self.terms[i]], k] = self.weights[i]
            yield items, place, matrix


def frequency(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share of a term's weight that a document with so many occurrences and length factor m gets: grows with the count, falls with m."""
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


@dataclass
class Node:
    start: int
    end: int
    children: list[Node]
    terms: np.ndarray
    shares: np.ndarray


class Tree:
    """An FP-tree of documents: vectors sorted by terms in frequency order, equal ones one entry; subtrees are runs of entries."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, k: int):
        """vectors: (places in the frequency order, counts), sorted by place. Of equal vectors with equal m, only the k smallest ids can be results."""
        keys = [v[0].astype(">u4").tobytes() for v in vectors]
        order = sorted(range(len(vectors)), key=lambda d: (keys[d], vectors[d][1].tobytes(), m[d], ids[d]))
        self.ids: list[list[int]] = []
        kept: list[int] = []
        for d in order:
            last = kept[-1] if kept else None
            if last is not None and m[last] == m[d] and keys[last] == keys[d] and np.array_equal(vectors[last][1], vectors[d][1]):
                if len(self.ids[-1]) < k:
                    self.ids[-1].append(int(ids[d]))
            else:
                kept.append(d)
                self.ids.append([int(ids[d])])
        self.m = m[kept]
        sizes = np.array([len(vectors[d][0]) for d in kept], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(sizes)])
        self.terms = np.concatenate([vectors[d][0] for d in kept]).astype(np.int64) if kept else np.zeros(0, np.int64)
        self.counts = np.concatenate([vectors[d][1] for d in kept]).astype(np.int64) if kept else np.zeros(0, np.int64)
        self.shares = frequency(self.counts, np.repeat(self.m, sizes))
        self.largest = np.zeros(n_terms, np.int64)
        shared = [self._shared(e) for e in range(1, len(kept))]
        self.root = self._grown(shared) if kept else None

    def _shared(self, e: int) -> int:
        """How many terms entry e begins with that the entry before it begins with too."""
        a, b = self.terms[self.ends[e - 1] : self.ends[e]], self.terms[self.ends[e] : self.ends[e + 1]]
        size = min(len(a), len(b))
        differ = np.flatnonzero(a[:size] != b[:size])
        return int(differ[0]) if len(differ) else size

    def _node(self, start: int, end: int, children: list[Node]) -> Node:
        """A run of entries with the bounds of its subtree."""
        a, b = self.ends[start], self.ends[end]
        largest, own = self.largest, self.terms[a:b]
        np.maximum.at(largest, own, self.counts[a:b])
        found = np.flatnonzero(largest) if b - a > len(largest) >> 3 else np.unique(own)
        counts = largest[found]
        largest[found] = 0
        return Node(start, end, children, found, frequency(counts, self.m[start:end].min()))

    def _grown(self, shared: list[int]) -> Node:
        """Branches part where neighbours begin alike for fewer terms than the others around them: found with a stack of open branches."""
        stack: list[tuple[int, int, list[tuple[int, int, list]]]] = [(0, 0, [])]  # (depth, start, branches so far)
        n = len(shared) + 1
        for e in range(n):
            depth = shared[e] if e + 1 < n else 0
            done = (e, e + 1, [])
            while stack[-1][0] > depth:
                _, start, inner = stack.pop()
                done = (start, e + 1, [*inner, done])
            if stack[-1][0] < depth:
                stack.append((depth, done[0], []))
            stack[-1][2].append(done)
        return self._bounded(stack[0][1], n, stack[0][2])

    def _bounded(self, start: int, end: int, branches: list[tuple[int, int, list]]) -> Node:
        """The node of a branch: large branches become nodes of their own, small neighbours share buckets. Not recursive: paths may be long."""
        # each frame: (start, end, iterator over branches, nodes so far, start and end of the open bucket)
        frames = [[start, end, iter(branches), [], None, None]]
        while True:
            frame = frames[-1]
            branch = next(frame[2], None)
            if branch is not None:
                a, b, inner = branch
                if b - a > SMALL:
                    while len(inner) == 1 and inner[0][0] == a and inner[0][1] == b:
                        inner = inner[0][2]  # a path without a fork
                    self._close(frame)
                    frames.append([a, b, iter(inner), [], None, None])
                elif frame[4] is not None and b - frame[4] <= BUCKET:
                    frame[5] = b
                else:
                    self._close(frame)
                    frame[4], frame[5] = a, b
                continue
            self._close(frame)
            nodes = frame[3]
            node = self._node(frame[0], frame[1], nodes if len(nodes) > 1 or (nodes and nodes[0].children) else [])
            frames.pop()
            if not frames:
                return node
            frames[-1][3].append(node)

    def _close(self, frame: list) -> None:
        if frame[4] is not None:
            frame[3].append(self._node(frame[4], frame[5], []))
            frame[4] = frame[5] = None

    def search(self, place: np.ndarray, matrix: np.ndarray, best: list[list[tuple[int, int]]], k: int) -> int:
        """Puts the documents into the heaps `best` of (score, -id), one for each item of the matrix. Returns how many entries were scored."""
        if self.root is None:
            return 0
        n_items, kind = matrix.shape[1], matrix.dtype
        least = np.array([b[0][0] if len(b) == k else 1 for b in best], kind)

        def scores(own: np.ndarray, shares: np.ndarray, active: np.ndarray) -> np.ndarray:
            at = place[own]
            if at.min(initial=0) < 0:
                known = at >= 0
                at, shares = at[known], shares[known]
            part = matrix[at[:, None], active] if 3 * len(active) < n_items else matrix[at]
            out = shares.astype(kind) @ part
            return out if part.shape[1] == len(active) else out[active]

        everyone = np.arange(n_items)
        stack = [(self.root, everyone, scores(self.root.terms, self.root.shares, everyone))]
        scored = 0
        while stack:
            node, active, bound = stack.pop()
            active = active[bound >= least[active]]
            if not len(active):
                continue
            if node.children:
                branches = [(child, active, scores(child.terms, child.shares, active)) for child in node.children]
                branches.sort(key=lambda b: b[2].max())
                stack.extend(branches)
                continue
            for e in range(node.start, node.end):
                scored += 1
                a, b = self.ends[e], self.ends[e + 1]
                found = scores(self.terms[a:b], self.shares[a:b], active)
                good = np.flatnonzero(found >= least[active])
                for item, score in zip(active[good].tolist(), found[good].tolist(), strict=True):
                    heap = best[item]
                    for own in self.ids[e]:
                        entry = (int(score), -own)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                        else:
                            break  # further ids are larger
                    if len(heap) == k:
                        least[item] = heap[0][0]
        return scored


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(ids, n, vectors) of bounded size from batches of (id, n, terms, counts)."""
    ids, sizes, vectors, entries = [], [], [], 0
    for batch in batches:
        own = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        ends = batch.column(2).offsets.to_numpy()
        flat, counts = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(3).values.to_numpy(zero_copy_only=False)
        for r in range(batch.num_rows):
            a, b = ends[r], ends[r + 1]
            if a == b:
                continue  # none of the items' terms: no score
            if ids and (len(ids) >= SHARD_ROWS or entries + b - a > SHARD_ENTRIES):
                yield np.array(ids, np.int64), np.array(sizes, np.int64), vectors
                ids, sizes, vectors, entries = [], [], [], 0
            ids.append(int(own[r]))
            sizes.append(int(n[r]))
            vectors.append((flat[a:b].copy(), counts[a:b].copy()))
            entries += b - a
    if ids:
        yield np.array(ids, np.int64), np.array(sizes, np.int64), vectors


def found(vectors: DataFrame, asked: list[Counter], vocabulary: dict[bytes, int], k: int) -> DataFrame:
    """(item, part, id, score): each task's best k for each item of a block.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), N documents of which df have it; m is 75 + 25 n N div L, n a document's terms and L
    those of all. A score is the sum over the item's terms, repeats included, of w ((10^9 tf) div (1000 tf + 12 m)); div rounds down.
    """
    totals = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, all_terms = totals["docs"], totals["terms"] or 0
    df = np.zeros(len(vocabulary), np.int64)
    for term, count in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toPandas().itertuples(index=False):  # a row for each term of a block
        df[term] = count
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df]
    items = Items([], [])
    for own in asked:
        at = sorted(own, key=lambda t: rank[t])
        items.terms.append(rank[at] if at else np.zeros(0, np.int64))
        items.weights.append(np.array([own[t] * weight[t] for t in at], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items.terms]
        groups = list(items.groups(len(rank))) if len(items.terms) <= ITEM_GROUP else None  # one group's matrix may stay
        for ids, n, rows in shards(batches):
            in_order = []
            for own, counts in rows:
                at = rank[own]
                by = np.argsort(at)
                in_order.append((at[by], counts[by]))
            tree = Tree(ids, 75 + (25 * n * n_docs) // all_terms, in_order, len(rank), k)
            for members, place, matrix in groups or items.groups(len(rank)):
                tree.search(place, matrix, best[members[0] : members[-1] + 1], k)
        part = TaskContext.get().partitionId() % PARTS
        rows = [(i, part, -own, score) for i, heap in enumerate(best) for score, own in heap]
        if rows:
            item, parts, ids, scores = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([item, parts, ids, scores], names=["item", "part", "id", "score"])

    return vectors.mapInArrow(trimmed(run), "item long, part long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_key, rank, doc_key, score): for each row of items its k best documents with a score above 0, equal scores by ascending id."""
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    dealt = items.select(F.col(f"`{item_key}`").alias("own"), F.col(f"`{text}`").alias("text")).withColumn("block", F.pmod(F.xxhash64("own", "text"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        asked = [(r["own"], terms(r["text"] or "")) for r in dealt.where(F.col("block") == block).collect()]  # about ITEM_BYTES
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in asked for t in own}))}
        if not vocabulary:
            continue
        vectors = staged(restricted(docs, doc_key, text, vocabulary), "search-vectors")
        lists = found(vectors, [Counter(vocabulary[t] for t in own) for _, own in asked], vocabulary, k)
        by = [F.desc("score"), F.col("id").asc()]
        parts = lists.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).where(F.col("rank") <= k)
        best = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, own) for i, (own, _) in enumerate(asked)], f"item long, own {kind}")
        own_id = F.when(F.col("id") != _NO_ID, F.col("id"))
        rows = best.join(F.broadcast(names), "item").select(F.col("own").alias(item_key), "rank", own_id.alias(doc_key), "score")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"`{item_key}` {kind}, rank int, `{doc_key}` long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_FOLDED = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '" + TERM + "')"

OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, len(t) AS n, t FROM (SELECT doc_id, {_FOLDED} AS t FROM documents) WHERE len(t) > 0
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d
), asked AS (
  SELECT i, item_id, term, count(*) AS repeats FROM (
    SELECT i, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_FOLDED} AS t FROM benchmark)) GROUP BY ALL
), tf AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(all_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term
), scored AS (
  SELECT i, item_id, d.r, d.doc_id,
         CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN d ON d.r = tf.r, totals
  GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
