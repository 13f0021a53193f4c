"""Queries on splits, samples and mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import text as X
from curatrix.operators import balance as B
from curatrix.operators import splits as P
from curatrix.plans import fixtures as fx
from curatrix.plans.catalog import query
from curatrix.plans.queries_metrics import _PRED, predicted

_HASHED = f"{fx.SCORED}, h AS (SELECT *, row_number() OVER (ORDER BY md5(id || ':42'), id) - 1 AS r, count(*) OVER () AS n FROM scored)"
_TIMED = f"{fx.POSTS}, t AS (SELECT *, row_number() OVER (ORDER BY coalesce(collected_at, (SELECT min(collected_at) FROM posts)), id) - 1 AS r, count(*) OVER () AS n FROM posts)"
_SET = "CASE WHEN gold_scam = 0 AND gold_topic = 0 THEN 'clean' WHEN gold_scam = 0 THEN 'topic_crypto' WHEN gold_topic = 0 THEN 'scam' ELSE 'scam|topic_crypto' END"
RATIOS = [("train", 0.6), ("valid", 0.1), ("calib", 0.05), ("holdout", 0.25)]


@query("random_split", f"WITH {_HASHED} SELECT id, CASE WHEN r < floor(n * (1 - 0.2e0)) THEN 'train' ELSE 'valid' END AS split FROM h")
def random_split(spark, sf):
    return P.random_split(fx.scored(spark, sf).select("id"), "id", 0.2)


@query("time_holdout", f"WITH {_TIMED} SELECT id, CASE WHEN r < floor(n * (1 - 0.25e0)) THEN 'train' ELSE 'holdout' END AS split FROM t")
def time_holdout(spark, sf):
    return P.time_holdout(fx.posts(spark, sf).select("id", "collected_at"), "collected_at", "id", ratio=0.25).select("id", "split")


@query("time_holdout_cutoff", f"WITH {fx.POSTS} SELECT id, CASE WHEN coalesce(collected_at >= TIMESTAMP '2024-01-01 08:00:00', false) THEN 'holdout' ELSE 'train' END AS split FROM posts")
def time_holdout_cutoff(spark, sf):
    return P.time_holdout(fx.posts(spark, sf).select("id", "collected_at"), "collected_at", "id", cutoff="2024-01-01 08:00:00").select("id", "split")


@query("time_split_3way", f"WITH {_TIMED}, s AS (SELECT id, collected_at, CASE WHEN n - 1 - r < greatest(1, floor(n * 0.1e0)) THEN 'holdout' WHEN n - 1 - r < greatest(1, floor(n * 0.1e0)) * 2 THEN 'calib' ELSE 'train' END AS split FROM t) SELECT split, count(*) AS n, min(collected_at) AS first, max(collected_at) AS last FROM s GROUP BY 1")
def time_split_3way(spark, sf):
    out = P.time_split_3way(fx.posts(spark, sf).select("id", "collected_at"), "collected_at", "id", 0.1, 0.1)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.min("collected_at").cast("timestamp_ntz").alias("first"), F.max("collected_at").cast("timestamp_ntz").alias("last"))


_QUOTAS = f"""g AS (SELECT {_SET} AS s, count(*) AS size FROM scored GROUP BY 1), k AS (SELECT s, size, split, place, round(size * ratio, 9) AS x FROM g, (VALUES (0, 'train', 0.6e0), (1, 'valid', 0.1e0), (2, 'calib', 0.05e0), (3, 'holdout', 0.25e0)) v(place, split, ratio)),
f AS (SELECT *, floor(x) AS fl, size - sum(floor(x)) OVER (PARTITION BY s) AS rest, row_number() OVER (PARTITION BY s ORDER BY x - floor(x) DESC, place DESC) AS turn FROM k), q AS (SELECT s, split, place, CAST(fl + CASE WHEN turn <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"""


@query("largest_remainder", f"WITH {fx.SCORED}, {_QUOTAS} SELECT s, split, quota FROM q")
def largest_remainder(spark, sf):
    groups = fx.scored(spark, sf).groupBy(F.array_join(F.array_sort("multi"), "|").alias("s")).agg(F.count("*").alias("size"))
    return P.largest_remainder(groups, "size", RATIOS, ["s"]).select("s", "split", "quota")


#: Row by row: a is what the splits have of the set, c what is left of their sizes, h the split that this row goes to.
_DEAL = f"""g AS (SELECT s, size, row_number() OVER (ORDER BY size DESC, '["' || replace(s, '|', '","') || '"]') AS i FROM (SELECT {_SET} AS s, count(*) AS size FROM scored GROUP BY 1)),
v AS (SELECT *, (SELECT count(*) FROM scored) * ratio AS x FROM (VALUES (1, 'train', 0.6e0), (2, 'valid', 0.1e0), (3, 'calib', 0.05e0), (4, 'holdout', 0.25e0)) v(place, split, ratio)),
z AS (SELECT place, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, place DESC) <= (SELECT count(*) FROM scored) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS room FROM v),
m AS (SELECT unnest([1, 2, 3, 4]) AS p), walk AS (
  SELECT i, 0 AS k, size, [0, 0, 0, 0]::BIGINT[] AS a, (SELECT list(CAST(room AS BIGINT) ORDER BY place) FROM z) AS c, 0 AS h FROM g WHERE i = 1
  UNION ALL
  SELECT i, k, size, list_transform(a, lambda x, j: x + CASE WHEN j = h THEN 1 ELSE 0 END), list_transform(c, lambda x, j: x - CASE WHEN j = h THEN 1 ELSE 0 END), h FROM (
    SELECT o.i, o.k, o.size, o.a, o.c, (SELECT p FROM m WHERE o.c[p] > 0 ORDER BY [0.6e0, 0.1e0, 0.05e0, 0.25e0][p] * o.size - o.a[p] DESC, o.c[p] DESC, p LIMIT 1) AS h FROM (
      SELECT CASE WHEN k < w.size THEN w.i ELSE n.i END AS i, CASE WHEN k < w.size THEN k + 1 ELSE 1 END AS k, CASE WHEN k < w.size THEN w.size ELSE n.size END AS size, CASE WHEN k < w.size THEN a ELSE [0, 0, 0, 0]::BIGINT[] END AS a, c
      FROM walk w LEFT JOIN g n ON n.i = w.i + 1 WHERE k < w.size OR n.i IS NOT NULL) o)
), q AS (SELECT g.s, v.place, v.split, coalesce(d.n, 0) AS quota FROM g CROSS JOIN v LEFT JOIN (SELECT i, h, count(*) AS n FROM walk WHERE h > 0 GROUP BY 1, 2) d ON d.i = g.i AND d.h = v.place)"""


@query("stratified_split", f"""WITH RECURSIVE {fx.SCORED}, {_DEAL}, b AS (SELECT *, coalesce(sum(quota) OVER (PARTITION BY s ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
r AS (SELECT id, {_SET} AS s, row_number() OVER (PARTITION BY {_SET} ORDER BY md5(id || ':42'), id) - 1 AS r FROM scored) SELECT id, split FROM r JOIN b ON r.s = b.s AND r.r >= before AND r.r < before + quota""")
def stratified_split(spark, sf):
    return P.stratified_split(fx.scored(spark, sf).select("id", "multi"), "multi", "id", RATIOS).select("id", "split")


@query("split_outputs", f"WITH {fx.SCORED} SELECT id, array_to_string(labels, ',') AS raw_labels, replace({_SET}, '|', ',') AS labels FROM scored")
def split_outputs(spark, sf):
    out = P.split_outputs(fx.scored(spark, sf).select("id", "labels", "multi"), "labels", F.col("multi"))
    return out.select("id", F.concat_ws(",", "raw_labels").alias("raw_labels"), F.concat_ws(",", "labels").alias("labels"))


@query("sample_n", f"WITH {_HASHED} SELECT id FROM h WHERE r < 50")
def sample_n(spark, sf):
    return P.sample_n(fx.scored(spark, sf).select("id"), "id", 50)


@query("rebalance_calib", f"""WITH {fx.SCORED}, s AS (SELECT id, gold, {fx.split_sql()} AS split FROM scored), a AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':42'), id) AS r FROM s WHERE split = 'train' AND gold = 'clean')
SELECT id, 'base' AS origin FROM s WHERE split = 'calib' UNION ALL SELECT id, 'added' FROM a WHERE r <= 100""")
def rebalance_calib(spark, sf):
    rows = fx.with_split(fx.scored(spark, sf))
    return P.rebalance_calib(rows.where("split = 'calib'").select("id"), rows.where("split = 'train' and gold = 'clean'").select("id"), "id", 100)


@query("oversample_hard_negatives", f"""WITH {fx.SCORED}, s AS (SELECT id, gold, p_scam, {fx.split_sql()} AS split FROM scored) SELECT id, 0 AS copy FROM s WHERE split = 'train'
UNION ALL SELECT id, unnest([1, 2, 3]) FROM s WHERE split = 'valid' AND gold = 'clean' AND p_scam >= 0.5e0""")
def oversample_hard_negatives(spark, sf):
    rows = fx.with_split(fx.scored(spark, sf))
    hard = P.hard_negatives(rows.where("split = 'valid'"), "multi", "p_scam", "id", least=0.5)
    return P.oversample(rows.where("split = 'train'").select("id"), hard.select("id"))


@query("mine_hard_negatives", f"WITH {fx.SCORED} SELECT id, p_scam FROM scored WHERE gold_scam = 0 AND gold_topic = 0 AND p_scam >= 0.3e0 ORDER BY p_scam DESC, id LIMIT 200")
def mine_hard_negatives(spark, sf):
    return P.hard_negatives(fx.scored(spark, sf), "multi", "p_scam", "id", n=200, least=0.3).select("id", "p_scam")


@query("mine_errors", f"WITH {_PRED} SELECT id, p_scam, CASE WHEN gold = 'clean' THEN 'fp' ELSE 'fn' END AS kind FROM pred WHERE (gold = 'clean' AND label = 'scam') OR (gold = 'scam' AND label = 'clean')")
def mine_errors(spark, sf):
    return P.mine_errors(predicted(spark, sf), "gold", "label").select("id", "p_scam", "kind")


_T = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query("unlabeled_corpus", f"""WITH i AS (SELECT {_T} AS t, 0 AS input_no, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT {_T}, 1, CAST(doc_id AS VARCHAR) FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY input_no, id) AS k FROM i WHERE length(t) >= 8) SELECT md5(t) AS digest, input_no, id FROM r WHERE k = 1""")
def unlabeled_corpus(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumn("id", F.col("doc_id").cast("string"))
    out = P.unlabeled_corpus([docs.where("doc_id % 2 = 1"), docs], X.clean_text(F.col("text"), normalize=False), "id")
    return out.select(F.md5("cleaned").alias("digest"), "input_no", "id")


@query("latest_snapshot", """WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n_snapshots FROM events)
SELECT user_id, event_id, event_type, n_snapshots FROM r WHERE k = 1""")
def latest_snapshot(spark, sf):
    return P.latest(fx.table(spark, sf, "events").withColumn("tie", F.col("event_id")), "user_id", "ts", ["event_id", "event_type"], "tie").select("user_id", "event_id", "event_type", "n_snapshots")


@query("id_dedupe_ingest", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS number FROM documents WHERE doc_id % 3 <> 0")
def id_dedupe_ingest(spark, sf):
    docs = fx.table(spark, sf, "documents")
    new = docs.select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x_"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("id"))
    return P.new_by_id(new, docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id")), "id").select("number")


@query("topk_reports", f"WITH {_PRED} SELECT id, p_scam FROM pred WHERE gold <> label ORDER BY p_scam DESC, id LIMIT 50")
def topk_reports(spark, sf):
    return predicted(spark, sf).where("gold <> label").orderBy(F.desc("p_scam"), "id").limit(50).select("id", "p_scam")


@query("capped_sample", f"WITH {fx.SCORED}, r AS (SELECT id, gold, row_number() OVER (PARTITION BY gold ORDER BY md5(id || ':42'), id) - 1 AS r, count(*) OVER () AS n FROM scored) SELECT id, gold FROM r WHERE r < floor(n * 0.1e0)")
def capped_sample(spark, sf):
    return P.balanced_sample(fx.scored(spark, sf).select("id", "gold"), "gold", "id", 0.1)


@query("label_balanced_sample")
def label_balanced_sample(spark, sf):
    """Clean rows that the model takes for scam are the hard negatives."""
    rows = fx.scored(spark, sf).select("id", "labels", "p_scam")
    return B.balanced_sample(rows, "labels", F.col("p_scam") >= 0.5, "id").select("id", "kind", F.round("weight", 6).alias("weight"))


@query("mixing_shares", f"""WITH {fx.SCORED}, e AS (SELECT count(*) AS n FROM (SELECT unnest(labels) AS label FROM posts) GROUP BY label), a AS (SELECT count(*) AS t, count(*) FILTER (WHERE len(labels) = 0) AS c, count(*) FILTER (WHERE len(labels) = 0 AND p_scam >= 0.5e0) AS h, (SELECT max(n) FROM e) AS m FROM scored),
s AS (SELECT 'clean' AS bucket, c AS n, c / t AS share, 0.7e0 AS low, 0.85e0 AS high FROM a UNION ALL SELECT 'positive', t - c, (t - c) / t, 0.15e0, 0.3e0 FROM a UNION ALL SELECT 'hard of clean', h, coalesce(h / nullif(c, 0), 0), 0.2e0, 0.4e0 FROM a UNION ALL SELECT 'commonest label', m, m / t, 0e0, 0.1e0 FROM a)
SELECT bucket, n, round(share, 9) AS share, low, high, CASE WHEN share < low - 1e-9 THEN 'below' WHEN share > high + 1e-9 THEN 'above' ELSE 'ok' END AS status FROM s""")
def mixing_shares(spark, sf):
    out = B.shares(fx.scored(spark, sf), "labels", F.col("p_scam") >= 0.5)
    return out.select("bucket", "n", F.round("share", 9).alias("share"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "status")


@query("domain_holdout_split", "SELECT page_id, CASE WHEN CAST(('0x' || substr(md5(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || ':42'), 1, 4)) AS BIGINT) < 16384 THEN 'holdout' ELSE 'train' END AS split FROM pages")
def domain_holdout_split(spark, sf):
    return P.host_split(fx.table(spark, sf, "pages").withColumn("urls", F.array("url")), "urls", 0.25).select("page_id", "split")
