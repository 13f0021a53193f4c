"""Near duplicates against all pairs: recall of links and clusters, hot buckets, and rows that have no words."""

import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import near_duplicates as near
from curatrix.plans.components import components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def all_links(texts, least=0.8):
    sets = {k: shingles(t) for k, t in texts.items()}
    keys = sorted(sets)
    return {(a, b) for at, a in enumerate(keys) for b in keys[at + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def roots(keys, links):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


@pytest.fixture(scope="module")
def texts():
    """60 families of near copies from 0 to 25 changed words in 100 (so similarities lie around the threshold), short texts, copies."""
    rng = random.Random(1)
    out = {}
    for family in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 40, 100, 300]))]
        for _ in range(rng.randrange(1, 9)):
            own = list(words)
            for _ in range(rng.randrange(1 + len(words) // 20)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out[len(out) * 3] = " ".join(own)
    base = [f"v{k}" for k in range(200)]
    for k in range(150):  # one hot group: a form with a name filled in, in one of two places or in both, so that some are far apart
        own = list(base)
        for at in ((20,), (20, 60, 100, 140), (60, 100, 140, 180))[k % 3]:
            own[at] = f"y{k}"
        out[len(out) * 3] = " ".join(own)
    for t in ["a b c", "A  b\tc", "a b", "one two three four five", "ONE two three four five", None, None, "", "   "] + ["same text of a few words again"] * 30:
        out[len(out) * 3] = t
    return out


def test_recall_and_precision(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = roots(texts, all_links(texts))
    got = {r.doc_id: (r.cluster, r.n) for r in near.near_duplicate_clusters(df, "doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    # clusters are never larger than those of all pairs, and nearly all members are in theirs
    assert all(want[got[k][0]] == want[k] for k in texts)
    right = sum(got[k][0] == want[k] for k in texts)
    assert right >= 0.97 * len(texts)
    sizes = {}
    for cluster, _ in got.values():
        sizes[cluster] = sizes.get(cluster, 0) + 1
    assert all(n == sizes[cluster] for cluster, n in got.values())


def test_links_are_pairs_that_meet_and_recall_of_direct_pairs(spark, texts):
    """Every link is near; of the pairs of small families, which bands alone decide, 0.9 are in one cluster by links."""
    distinct = {k: t for k, t in texts.items() if shingles(t)}
    sets = near.shingled(spark.createDataFrame(list(distinct.items()), "key long, text string"), "text")
    path = near.staged(sets, "test-sets")
    got = {tuple(sorted((r.member, r.center))) for r in near.links(path).collect()}
    exact = all_links(distinct)
    assert got <= exact
    met = path.transform(near.bands).select("key", "band", "bucket")
    pairs = met.alias("a").join(met.alias("b"), ["band", "bucket"]).where("a.key < b.key").select(F.col("a.key"), F.col("b.key")).distinct().collect()
    assert len(exact & {tuple(p) for p in pairs}) >= 0.95 * len(exact)
    # no bucket's pairs are all written: links stay near the number of rows, pairs don't
    assert len(got) <= 5 * len(distinct) and 3 * len(got) < len(exact)


def test_hot_copies_and_empty_tables(spark, texts, monkeypatch):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted(map(tuple, near.near_duplicate_clusters(df, "doc_id", "text").collect()))
    monkeypatch.setattr(near, "HOT_COPIES", 5)
    monkeypatch.setattr(near, "CENTER_PAIRS", 7)
    assert sorted(map(tuple, near.near_duplicate_clusters(df, "doc_id", "text").collect())) == want
    assert near.near_duplicate_clusters(df.limit(0), "doc_id", "text").count() == 0


def test_components_of_chains_and_rings(spark):
    links = [(k, k + 1) for k in range(100, 163)] + [(7, 3), (3, 9), (9, 7), (5, 5), (None, 1), (2, None)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 100 for k in range(100, 164)}, 3: 3, 7: 3, 9: 3, 5: 5}


def test_only_bands_and_named_sets_are_dealt_out(spark, texts, monkeypatch):
    sets = near.staged(near.shingled(spark.createDataFrame([(k, t) for k, t in texts.items() if shingles(t)], "key long, text string"), "text"), "test-sets")
    met = near.bands(sets)
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    # plainly: the least second hash of each bin, bands by all of their bins
    want = {}
    for r in sets.select("key", F.expr("transform(hashes, h -> struct(pmod(h, 80) AS bin, xxhash64(h, 1) AS least)) AS h")).collect():
        least = {}
        for b, x in r.h:
            least[b] = min(x, least.get(b, x))
        for band in range(16):
            if own := tuple((b, least[b]) for b in range(5 * band, 5 * band + 5) if b in least):
                want[r.key, band] = own
    got = {(r.key, r.band): r.bucket for r in met.collect()}
    assert got.keys() == want.keys() and len(set(zip([want[k] for k in got], got.values(), strict=True))) == len(set(got.values())) == len({(k[1], want[k]) for k in got})
    pairs = near.staged(sets.limit(3).select(F.col("key").alias("member"), F.col("key").alias("center")), "test-pairs")
    assert near.named_by(pairs, sets).count() == 3
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = sorted(map(tuple, near.near_duplicate_clusters(df, "doc_id", "text").collect()))
    monkeypatch.setattr(near, "FEW", 1)
    assert sorted(map(tuple, near.near_duplicate_clusters(df, "doc_id", "text").collect())) == want


def test_clusters_are_those_of_all_pairs(spark, texts, monkeypatch):
    """Pairs that no band shows, or that a bucket's rounds don't reach, were left apart."""
    distinct = {k: t for k, t in texts.items() if shingles(t)}
    sets = near.staged(near.shingled(spark.createDataFrame(list(distinct.items()), "key long, text string"), "text"), "test-sets")
    want = roots(distinct, all_links(distinct))
    assert roots(distinct, map(tuple, near.links(sets, n_bands=1, rounds=1).collect())) == want
    monkeypatch.setattr(near, "FEW", 1)
    assert roots(distinct, map(tuple, near.links(sets, n_bands=1, rows=80, rounds=1).collect())) == want


def test_sets_that_are_alone_are_similar_to_none(spark, texts):
    distinct = {k: t for k, t in texts.items() if shingles(t)}
    sets = near.staged(near.shingled(spark.createDataFrame(list(distinct.items()), "key long, text string"), "text"), "test-sets")
    linked = {k for pair in all_links(distinct) for k in pair}
    found = {r.key for r in near.alone(sets, 0.8).collect()}
    assert found and not found & linked
    for similarity in (0.3, 0.5, 0.95):
        assert not {r.key for r in near.alone(sets, similarity).collect()} & {k for pair in all_links(distinct, similarity) for k in pair}
