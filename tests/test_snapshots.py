"""Edit chains against a walk, and values carried over ranges of a key that is cut."""

import random

from curatrix.operators import snapshots
from curatrix.plans.ranking import previous_values


def test_chains_of_any_length_from_parts_of_histories(spark):
    rng, rows, want = random.Random(2), [], {}
    for chain in range(60):
        ids = [f"{chain:03}-{k:03}" for k in range(rng.choice([1, 2, 3, 20, 70]))]
        for k, own in enumerate(ids):
            rows.append((own, ids[max(0, k - rng.randrange(1, 4)) : k + 1] if k else [own]))
            want[own] = (ids[0], k + 1)
    rows += [("alone", None), ("alone", []), ("tail", ["gone", "tail"]), ("c1", ["c2", "c1"]), ("c2", ["c1", "c2"]), (None, None), ("after", ["c1", "after"])]
    want |= {"alone": ("alone", 1), "gone": ("gone", 1), "tail": ("gone", 2), "c1": (None, None), "c2": (None, None), "after": (None, None)}
    df = spark.createDataFrame(rows, "id string, history array<string>")
    got = {r.id: (r.root, r.version) for r in snapshots.edit_chains(df.repartition(5)).collect()}
    assert got == want
    assert snapshots.edit_chains(df.limit(0)).count() == 0


def test_previous_values_of_a_key_that_is_cut(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "hot", "hot", "hot", "b", f"k{rng.randrange(30)}"]), k, rng.choice([None, k % 11])) for k in range(2000)]
    rng.shuffle(rows)
    last, want = {}, []
    for key, at, v in sorted(rows, key=lambda r: r[1]):
        want.append((key, at, v, last.get(key)))
        last[key] = v
    df = spark.createDataFrame(rows, "key string, at long, v long")
    got = previous_values(df.repartition(6), ["key"], ["at"], ["v"])
    assert got.columns == ["key", "at", "v", "previous_v"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    changes = {(r.key, r.at): r.change_v for r in snapshots.metric_changes(df, "key", ["at"], ["v"]).collect()}
    assert changes == {(k, a): None if v is None or p is None else v - p for k, a, v, p in want}


def test_rounds_write_only_ids_that_have_not_arrived(spark, monkeypatch):
    rows = [(str(k), [str(k - 1), str(k)] if k % 10 else [str(k)]) for k in range(100)] + [(f"s{k}", None) for k in range(200)] + [("x", ["y", "x"]), ("y", ["x", "y"])]
    df = spark.createDataFrame(rows, "id string, history array<string>")
    written, staged = [], snapshots.staged
    monkeypatch.setattr(snapshots, "staged", lambda d, label: [out := staged(d, label), written.append(out.count())][0])
    got = {r.id: (r.root, r.version) for r in snapshots.edit_chains(df).collect()}
    assert got == {**{str(k): (str(k // 10 * 10), k % 10 + 1) for k in range(100)}, **{f"s{k}": (f"s{k}", 1) for k in range(200)}, "x": (None, None), "y": (None, None)}
    assert written[:4] == [302, 92, 82, 62]  # before, 302 each round
