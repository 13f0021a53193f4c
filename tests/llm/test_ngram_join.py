import random

import numpy as np
from pyspark.sql import Row

from curatrix.llm import ngram_join
from curatrix.llm.components import components


def brute(rows, n, percent):
    """(doc_id, size, component) by all pairs; rows: (doc_id, text)."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)}) if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(rng, bases, copies, words, edits):
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*words))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(copy))
                action = rng.random()
                if action < 0.5:
                    copy[at] = rng.choice(vocabulary)
                elif action < 0.75 and len(copy) > 1:
                    del copy[at]
                else:
                    copy.insert(at, rng.choice(vocabulary))
            out.append(" ".join(copy))
    return out


def check(spark, rows, n, percent, partitions=7):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_classes(df, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    texts = near_copies(rng, 12, 12, (3, 40), 2) + near_copies(rng, 8, 14, (100, 300), 8) + near_copies(rng, 5, 30, (60, 90), 6)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    check(spark, rows, 3, 90)
    check(spark, rows, 5, 80)


def test_edge_cases(spark):
    long = " ".join(f"x{k}" for k in range(30_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (3, "one"), (4, "one"), (None, "one"), (None, "lonely text here now"), (None, None),
            (5, "a b"), (6, "A  B"), (7, "b a"), (8, long), (9, long + " end"), (9, "É é"), (10, "é É"), (11, "a b c a b c a b c")]
    check(spark, rows, 3, 90)
    empty = spark.createDataFrame([], "doc_id long, text string, component_id string")
    assert ngram_join.similarity_classes(empty, 3, 90).count() == 0


def test_allocation_covers_the_greatest_difference():
    starts = ngram_join.band_starts(90, 5000)
    for low, after in zip(starts, starts[1:], strict=False):
        for sets in (1, 10**4, 10**9):
            band = ngram_join.allocate(low, after - 1, 90, sets, low)
            assert band.most == 0 and band.singles + band.doubles == 0 or band.singles + 2 * band.doubles >= band.most + 1 + band.spare


def test_similar_sets_meet_in_a_segment():
    rng = np.random.default_rng(2)
    starts = ngram_join.band_starts(80, 400)
    for sets in (10, 10**12):
        bands = [ngram_join.allocate(a, b - 1, 80, sets, a) for a, b in zip(starts, starts[1:], strict=False)]
        for _ in range(400):
            size = int(rng.integers(2, 350))
            x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            drop = int(rng.integers(0, size // 5 + 1))
            y = np.unique(np.r_[x[drop:], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)])
            both = len(np.intersect1d(x, y))
            if both * 100 < 80 * (len(x) + len(y) - both) or len(x) == len(y) == both:
                continue
            (a, ka), (b, kb) = ngram_join.signatures(x, bands, 80), ngram_join.signatures(y, bands, 80)
            assert set(a[ka == 0]) & set(b) or set(b[kb == 0]) & set(a)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)]
    df = spark.createDataFrame([Row(u=a, v=b) for a, b in edges], "u long, v long")
    got = {r.node: r.comp for r in components(df).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        changed = False
        for a, b in edges:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
        if not changed:
            break
    assert got == parent
    assert components(df.limit(0)).count() == 0


def _deltas(spark, sets, most, twice=()):
    rows = [(0, k, len(s), most, [int(e) for e in s]) for k, s in enumerate(sets)]
    return spark.createDataFrame(rows + [rows[k] for k in twice], "around long, node long, size long, most long, delta array<long>").repartition(5)


def test_prefixes_begin_with_what_few_sets_have(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ORDER_SAMPLE", 1)  # the sample tells nothing of elements that a few sets have
    rng = random.Random(5)
    pool = rng.sample(range(10**6), 200)
    sets = [[10**6 + 100 * k + j for j in range(15 if k % 3 else 30)] + rng.sample(pool, 60) for k in range(30)]
    keys = [ngram_join.keyed(0, np.array(s, np.uint64)).view(np.int64).tolist() for s in sets]
    held = {}
    for key in {x for s in keys for x in s}:
        held[key] = sum(key in s for s in keys)
    expected = set()
    for k, s in enumerate(keys):
        first = sorted(s, key=lambda x: (held[x], x))[:20]
        expected |= {(x, at + 1, k, len(s), len(s)) for at, x in enumerate(first) if held[x] > 1}
    got = ngram_join.prefixes(_deltas(spark, sets, 20)).select("key", "place", "node", "size", "d").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected
    assert {r.node % 3 for r in got} == {1, 2}  # sets with more elements of their own than `most` meet nothing


def test_similar_sets_meet_whatever_is_common(spark, monkeypatch):
    """Prefixes of similar sets share an element within the places that their difference allows, with common elements and repeated rows."""
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    rng = random.Random(6)
    sets = []
    for _ in range(8):
        base = rng.sample(range(400), 50)
        sets += [sorted({*rng.sample(base, rng.randint(40, 50)), *rng.sample(range(400), rng.randint(0, 6))}) for _ in range(6)]
    rows = ngram_join.prefixes(_deltas(spark, sets, 51, twice=(0, 7, 7))).collect()
    assert len(rows) == len(set(rows))
    places = {}
    for r in rows:
        places.setdefault(r.node, {})[r.key] = r.place
    for a in range(len(sets)):
        for b in range(a):
            h = 20 * (len(sets[a]) + len(sets[b])) // 180
            if len({*sets[a]} ^ {*sets[b]}) <= h:
                gap = len(sets[a]) - len(sets[b])
                both = places[a].keys() & places[b].keys()
                assert any(places[b][k] <= (h - gap) // 2 + 1 and places[a][k] <= (h + gap) // 2 + 1 for k in both)


def test_equals_all_pairs_whatever_the_order(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ORDER_SAMPLE", 1)
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    rng = random.Random(7)
    texts = near_copies(rng, 6, 30, (8, 60), 14)
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[9])]
    check(spark, rows, 3, 80)


def test_sets_that_are_mostly_their_own_are_not_dealt_out_whole(spark, monkeypatch):
    """Lonely sets are told by a share of their elements; those that are similar to another one, or of which all is shared, stay."""
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    rng = random.Random(8)
    pool = rng.sample(range(10**6), 100)
    lonely = [[10**6 + 1000 * k + j for j in range(80)] + rng.sample(pool, 20) for k in range(30)]
    pairs = []
    for k in range(10):
        base = [10**8 + 1000 * k + j for j in range(100)]
        pairs += [base, base[:-8] + [10**9 + 100 * k + j for j in range(8)]]
    shared = [rng.sample(pool, 60) for _ in range(5)]
    sets = lonely + pairs + shared
    # a set that comes twice is still one
    left = ngram_join.crowded(_deltas(spark, sets, 21, twice=(0, 1, 30)), 80).collect()
    assert sorted(r.node for r in left) == list(range(30, len(sets)))


def test_equals_all_pairs_whatever_share_tells_lonely_sets(spark, monkeypatch):
    rng = random.Random(9)
    phrase = [f"p{k}" for k in range(12)]
    texts = near_copies(rng, 5, 30, (8, 60), 14) + [" ".join(phrase + [f"own{k}x{j}" for j in range(16)]) for k in range(80)]
    rng.shuffle(texts)
    dealt = []
    prefixes = ngram_join.prefixes
    monkeypatch.setattr(ngram_join, "prefixes", lambda deltas: (dealt.append(deltas.where("around = 0").count()), prefixes(deltas))[1])
    for share in (0, 2, 5):
        monkeypatch.setattr(ngram_join, "ALONE_SHARE", share)
        check(spark, list(enumerate(texts)), 5, 80)
    assert len(dealt) == 6 and dealt[1] > dealt[3] >= dealt[5]
