import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from curatrix.llm import ranked_search as search

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return LETTERS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Rows of (item, rank, doc, score), every document scored for every item."""
    counted = [(own, Counter(words(text)), len(words(text))) for own, text in docs if words(text)]
    n, total = len(counted), sum(size for _, _, size in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for own, c, size in counted:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if score > 0:
                scores.append((-score, own is None, own or 0, own))
        out += [(item, rank + 1, own, -low) for rank, (low, _, _, own) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame([(own, t, "x", 1) for own, t in docs], "doc_id long, text string, term string, Score int"), spark.createDataFrame(items, "item_id long, text string")


def texts(rng, n, vocabulary, most):
    return [" ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(3)
    vocabulary = [f"w{j}" for j in range(60)] + ["É", "日本", "Naïve", "a1", "B"]
    docs = [(k * 3, t) for k, t in enumerate(texts(rng, 400, vocabulary, 40))]
    docs += [(5000 + k, "w3 w4 w59 w4.") for k in range(90)]  # one group of copies, more than k
    docs += [(9, docs[3][1]), (9, docs[3][1]), (None, "w1 w58"), (None, None), (6000, None), (6001, ""), (6002, "... --"), (6003, "w57 " * 30_000), (-4, "w57 É naïve")]
    items = [(k, t) for k, t in enumerate(texts(rng, 25, vocabulary, 20))] + [(3, "w3 w4 w59"), (3, "w3 w4 w59"), (None, "w58"), (90, None), (91, ""), (92, "nowhere"), (93, "W57 é 日本 a1-b")]
    return docs, items


def test_equals_brute_force(spark, mixed, monkeypatch):
    docs, items = mixed
    a, b = frames(spark, docs, items)
    got = lambda k: sorted((tuple(r) for r in search.search(a, b, k).collect()), key=repr)
    assert got(7) == brute(docs, items, 7)
    monkeypatch.setattr(search, "ITEM_BYTES", 200)  # several passes
    assert got(20) == brute(docs, items, 20)


@pytest.mark.parametrize(("small", "bucket", "rows", "group"), [(1, 1, 10_000, 256), (3, 8, 50, 4), (16, 64, 200, 1)])
def test_trees_of_any_shape_give_the_same(mixed, monkeypatch, small, bucket, rows, group):
    docs, items = mixed
    monkeypatch.setattr(search, "SMALL", small)
    monkeypatch.setattr(search, "BUCKET", bucket)
    monkeypatch.setattr(search, "ITEM_GROUP", group)
    rng = random.Random(5)
    n_terms, k = 40, 3
    vectors = [(np.array(sorted(rng.sample(range(n_terms), rng.randrange(1, 9)))),) for _ in range(300)]
    vectors = [(v[0], np.array([rng.randrange(1, 4) for _ in v[0]])) for v in vectors] + [(np.arange(30), np.ones(30, int))] * 20
    ids, m = np.array(rng.sample(range(1000), len(vectors))), np.array([rng.randrange(75, 90) for _ in vectors])
    asked = search.Items([], [])
    for _ in range(9):
        own = np.array(sorted(rng.sample(range(n_terms), 6)))
        asked.terms.append(own)
        asked.weights.append(np.array([rng.randrange(0, 900) for _ in own]))
    best = [[] for _ in asked.terms]
    for at in range(0, len(vectors), rows):
        tree = search.Tree(ids[at : at + rows], m[at : at + rows], vectors[at : at + rows], n_terms, k)
        for members, place, matrix in asked.groups(n_terms):
            tree.search(place, matrix, best[members[0] : members[-1] + 1], k)
    for item, heap in enumerate(best):
        weight = dict(zip(asked.terms[item].tolist(), asked.weights[item].tolist(), strict=True))
        scores = [(sum(weight.get(int(t), 0) * int(10**9 * c // (1000 * c + 12 * m[d])) for t, c in zip(*vectors[d], strict=True)), -int(ids[d])) for d in range(len(vectors))]
        assert sorted(heap) == sorted(sorted([s for s in scores if s[0] > 0])[-k:])


def test_bounds_leave_most_documents_out():
    """A rare term and a few good documents: only branches that can still win are walked."""
    rng = random.Random(6)
    vectors = [(np.array(sorted({0, *rng.sample(range(1, 300), 6)})), np.ones(7, int)) for _ in range(4000)]
    vectors = [(t, c[: len(t)]) for t, c in vectors] + [(np.array([0, 250, 251, 252]), np.ones(4, int))] + [(np.array([0, j, 250, 251, 252]), np.ones(5, int)) for j in range(1, 9)]
    tree = search.Tree(np.arange(len(vectors)), np.full(len(vectors), 100), vectors, 300, 5)
    asked = search.Items([np.array([0, 250, 251, 252])], [np.array([1, 900, 900, 900])])
    (_, place, matrix), best = next(asked.groups(300)), [[]]
    assert tree.search(place, matrix, best, 5) < 1000
    assert len(best[0]) == 5


def test_large_weights_stay_whole_numbers():
    asked = search.Items([np.array([0])], [np.array([1 << 40])])
    (_, place, matrix), best = next(asked.groups(1)), [[]]
    assert matrix.dtype == np.int64
    search.Tree(np.array([4]), np.array([75]), [(np.array([0]), np.array([3]))], 1, 2).search(place, matrix, best, 2)
    assert best == [[((1 << 40) * (3 * 10**9 // 3900), -4)]]


def test_empty_tables(spark, mixed):
    a, b = frames(spark, *mixed)
    assert search.search(a.limit(0), b).count() == 0
    assert search.search(a, b.limit(0)).count() == 0
    assert search.search(a.where("doc_id in (6000, 6001, 6002)"), b).count() == 0


def test_sql_equals_query(spark, sf_dir):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = sorted(tuple(r) for r in search.op11_ranked_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(duck.sql(search.OP11_SQL).fetchall())
    assert len(got) > 100
