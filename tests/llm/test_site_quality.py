import numpy as np
from pyspark.sql import Row

from curatrix.llm import site_quality


def test_posteriors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for host, rate in (("a", 0.9), ("b", 0.2), (None, 0.6), ("d", 0.5)):
        for path, n in (("x", 40), ("y", 3), (None, 1)):
            rows += [(host, path, float(np.clip(rng.normal(rate, 0.2), 0.01, 0.99))) for _ in range(n)]
    df = spark.createDataFrame([Row(doc_id=k, host=h, path=q, p=p, score="x") for k, (h, q, p) in enumerate(rows)], "doc_id long, host string, path string, p double, score string")
    got = {r.doc_id: r for r in site_quality.site_quality(df, "host", "path").collect()}
    mean = sum(p for *_, p in rows) / len(rows)

    def strength(groups):
        groups = [g for g in groups if g[0] > 1]
        seen = sum(n * (s / n - m) ** 2 for n, s, m in groups)
        chance, room = sum(m * (1 - m) for *_, m in groups), sum(m * (1 - m) * (n - 1) for n, _, m in groups)
        share = (seen - chance) / room
        return min(1000.0, max(2.0, 1 / share - 1 if share > 0 else 1000.0))

    hosts = {h: [p for g, _, p in rows if g == h] for h in {r[0] for r in rows}}
    k1 = strength([(len(v), sum(v), mean) for v in hosts.values()])
    host_rate = {h: (sum(v) + k1 * mean) / (len(v) + k1) for h, v in hosts.items()}
    paths = {(h, q): [p for g, r, p in rows if (g, r) == (h, q)] for h, q in {r[:2] for r in rows}}
    k2 = strength([(len(v), sum(v), host_rate[h]) for (h, _), v in paths.items()])
    logit = lambda x: np.log(x / (1 - x))
    for k, (h, q, p) in enumerate(rows):
        v = paths[h, q]
        rate = (sum(v) - p + k2 * host_rate[h]) / (len(v) - 1 + k2)
        assert np.isclose(got[k].host_rate, host_rate[h]) and np.isclose(got[k].path_rate, rate)
        assert np.isclose(got[k].score, 1 / (1 + np.exp(-(logit(p) - logit(mean) + logit(rate)))))
    assert site_quality.site_quality(df.limit(0), "host", "path").count() == 0


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = site_quality.op3_site_quality(spark, sf).join(labels, "doc_id").where("held_out").collect()
    y = np.array([r.quality for r in got])
    assert np.mean([r.keep == bool(r.quality) for r in got]) > 0.97
    assert np.mean([r.keep for r in got if r.quality == 1]) > 0.97 and len(y) > 500


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x " * 200_000), (3, "ok"), (3, "ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source", "cast(null as string) as lang", "'c' as P")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = site_quality.learn(df, none)
    assert model == 0.5
    got = site_quality.site_quality(site_quality.with_probability(df, model), "source", "lang").collect()
    assert len(got) == 6 and all(abs(r.score - 0.5) < 1e-9 for r in got)
    x = np.array([site_quality.features(t) for _, t in rows])
    fitted = site_quality.Classifier.fit(x, np.array([0, 0, 1, 1, 1, 1]), 0.5)
    got = site_quality.with_probability(df, fitted).collect()
    assert all(0 <= r.p <= 1 for r in got)
