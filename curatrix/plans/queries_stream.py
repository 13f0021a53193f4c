"""Queries on streams, training and campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import campaigns as K
from curatrix.operators import near_duplicates as near
from curatrix.operators import training as R
from curatrix.operators import wordpiece as W
from curatrix.plans import fixtures as fx
from curatrix.plans.catalog import query
from curatrix.sources.files import shared_path, staged
from curatrix.streaming import flags as G

_U = fx.uniform_sql("doc_id", "scam")


def _score():
    return F.lit(6e-1) * fx.uniform("doc_id", "scam")


@query("stream_flag_posts", f"SELECT doc_id, 6e-1 * ({_U}) AS score, 6e-1 * ({_U}) >= 0.3e0 AS flagged FROM documents WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 20")
def stream_flag_posts(spark, sf):
    stream = G.flag_posts(G.read_table_stream(spark, f"{sf}/documents.parquet"), "text", _score(), 0.3)
    return G.run_to_table(stream.select("doc_id", "score", "flagged"), "stream-flags")


@query("stream_microbatch_sink", f"SELECT doc_id, 6e-1 * ({_U}) AS score, 6e-1 * ({_U}) >= 0.3e0 AS flagged FROM documents WHERE length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 20")
def stream_microbatch_sink(spark, sf):
    stream = G.flag_posts(G.read_table_stream(spark, f"{sf}/documents.parquet", 4), "text", _score(), 0.3)
    return G.run_by_batches(stream.select("doc_id", "score", "flagged"), "stream-batches")


@query("stream_skip_unchanged", """WITH e AS (SELECT doc_id % 997 AS element, doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS seen FROM documents),
l AS (SELECT *, lag(seen) OVER (PARTITION BY element ORDER BY doc_id) AS before, row_number() OVER (PARTITION BY element ORDER BY doc_id) AS k FROM e) SELECT element, doc_id, seen FROM l WHERE k = 1 OR seen IS DISTINCT FROM before""")
def stream_skip_unchanged(spark, sf):
    docs = G.read_table_stream(spark, f"{sf}/documents.parquet")
    rows = docs.select((F.col("doc_id") % 997).alias("element"), "doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("source")).alias("seen"))
    return G.run_to_table(G.changes(rows, "element", "doc_id", "seen"), "stream-changes")


@query("stream_clear_transitions", f"""WITH e AS (SELECT doc_id % 97 AS element, doc_id, 6e-1 * ({_U}) >= 0.3e0 AS flagged FROM documents), l AS (SELECT *, lag(flagged) OVER (PARTITION BY element ORDER BY doc_id) AS before FROM e)
SELECT element, doc_id, flagged FROM l WHERE before IS NOT NULL AND flagged <> before""")
def stream_clear_transitions(spark, sf):
    docs = G.read_table_stream(spark, f"{sf}/documents.parquet")
    rows = docs.select((F.col("doc_id") % 97).alias("element"), "doc_id", (_score() >= 0.3).alias("flagged"))
    return G.run_to_table(G.changes(rows, "element", "doc_id", "flagged", first=False), "stream-clears")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    events = G.read_table_stream(spark, f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return G.run_to_table(G.distinct_within(events, "at", "400 days", ["user_id", "event_type"]).select("user_id", "event_type"), "stream-distinct")


@query("stream_scored_metrics", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_scored_metrics(spark, sf):
    events = G.read_table_stream(spark, f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    out = G.run_by_batches(G.window_counts(events, "at", "event_type", "1 day", "400 days"), "stream-windows", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


_DRIFT = """WITH b AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS baseline FROM events GROUP BY 1), d AS (SELECT date_trunc('day', ts) AS day, event_type FROM events),
w AS (SELECT day, count(*) AS total FROM d GROUP BY 1 HAVING day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)), c AS (SELECT day, event_type, count(*) AS n FROM d GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, event_type, coalesce(n, 0) AS n, total, round(coalesce(n, 0) / total, 9) AS rate, round(baseline, 9) AS baseline, abs(coalesce(n, 0) / total - baseline) > 0.01 AS drifted
FROM w CROSS JOIN b LEFT JOIN c USING (day, event_type)"""


@query("stream_rate_drift", _DRIFT)
def stream_rate_drift(spark, sf):
    table = fx.table(spark, sf, "events")
    total = table.agg(F.count("*").alias("total"))
    baseline = table.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("event_type", F.col("n") / F.col("total"))
    events = G.read_table_stream(spark, f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    out = G.run_by_batches(G.rate_drift(events, "at", "event_type", "1 day", "1 hour", baseline, 0.01), "stream-drift")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total", F.round("rate", 9).alias("rate"), F.round("baseline", 9).alias("baseline"), "drifted")


@query("policy_actions", f"WITH {fx.SCORED} SELECT CASE WHEN p_scam >= 0.9e0 THEN 'hide' WHEN p_scam >= 0.6e0 THEN 'warn' WHEN p_scam >= 0.4e0 THEN 'badge' ELSE 'none' END AS action, count(*) AS n FROM scored GROUP BY 1")
def policy_actions(spark, sf):
    return fx.scored(spark, sf).groupBy(G.policy_action(F.col("p_scam"), [("hide", 0.9), ("warn", 0.6), ("badge", 0.4)]).alias("action")).agg(F.count("*").alias("n"))


@query("near_threshold_band", f"WITH {fx.SCORED} SELECT id, p_scam FROM scored WHERE abs(p_scam - 0.5e0) <= 0.05e0")
def near_threshold_band(spark, sf):
    return G.near_threshold(fx.scored(spark, sf), "p_scam", 0.5, 0.05).select("id", "p_scam")


@query("ngram_features", """WITH d AS (SELECT doc_id, coalesce(lower(text), '') AS text FROM documents), t AS (SELECT doc_id, length(text) AS size, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')) AS words FROM d)
SELECT doc_id, CAST(words + greatest(words - 1, 0) + greatest(size - 1, 0) + greatest(size - 2, 0) + greatest(size - 3, 0) + greatest(size - 4, 0) AS BIGINT) AS n_grams FROM t""")
def ngram_features(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    out = R.ngram_pipeline("text").fit(R.with_chars(docs, "text")).transform(R.with_chars(docs, "text"))
    return R.count_sums(out, "doc_id", "features", "n_grams")


def _labelled(spark, sf):
    return fx.with_split(fx.scored(spark, sf).select("doc_id", "text", "gold", "multi"))


@query("train_ova_classifier")
def train_ova_classifier(spark, sf):
    docs = _labelled(spark, sf)
    trained = R.train_one_vs_rest(docs.where("split = 'train'"), "text", "multi")
    return R.score_posts(docs, "text", trained).select("doc_id", "gold", "split", "p_clean", "p_topic_crypto", "p_scam")


@query("score_posts")
def score_posts(spark, sf):
    """Posts scored with a model that was stored and read back."""
    docs, path = _labelled(spark, sf), shared_path(spark, "model")
    R.save_trained(R.train_one_vs_rest(docs.where("split = 'train'"), "text", "multi"), path)
    return R.score_posts(docs, "text", R.load_trained(spark, path)).select("doc_id", "p_clean", "p_topic_crypto", "p_scam")


@query("two_stage_classifier")
def two_stage_classifier(spark, sf):
    docs = _labelled(spark, sf)
    stages = R.train_two_stage(docs.where("split = 'train'"), "text", "multi")
    out = R.score_two_stage(docs, "text", stages)
    return out.select("doc_id", "p_scam", "p_topic_crypto", "p_clean", F.when(F.col("p_scam") >= 0.5, "scam").when(F.col("p_topic_crypto") >= 0.5, "topic_crypto").otherwise("clean").alias("label"))


@query("encode_batch")
def encode_batch(spark, sf):
    vocabulary = staged(W.vocabulary_from(fx.table(spark, sf, "benchmark"), "text"), "vocabulary")
    out = W.encode_batch(fx.table(spark, sf, "documents"), "doc_id", "text", vocabulary)
    return out.select("doc_id", F.concat_ws(" ", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), F.aggregate("mask", F.lit(0), lambda a, b: a + b).alias("n"))


_NEAR = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * i >= 4 * (a.n + b.n - i)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id), c AS (SELECT doc_id, min(root) AS cluster FROM r GROUP BY 1)
SELECT doc_id, cluster, count(*) OVER (PARTITION BY cluster) AS n FROM c"""


@query("near_duplicate_clusters", _NEAR)
def near_duplicate_clusters(spark, sf):
    return near.near_duplicate_clusters(fx.table(spark, sf, "documents"), "doc_id", "text")


def _runs(what: str, source: str) -> str:
    return f"""WITH p AS ({source}), q AS (SELECT *, lag(t) OVER (PARTITION BY {what} ORDER BY t, handle) AS before FROM p), r AS (SELECT *, sum(CASE WHEN before IS NULL OR t >= before + 600 THEN 1 ELSE 0 END) OVER (PARTITION BY {what} ORDER BY t, handle ROWS UNBOUNDED PRECEDING) AS run FROM q)
SELECT {what}, min(t) AS start, max(t) AS "end", count(*) AS n_posts, count(DISTINCT handle) AS n_handles FROM r GROUP BY {what}, run HAVING count(DISTINCT handle) >= 2"""


@query("coordinated_bursts", _runs("digest", "SELECT md5(text) AS digest, source AS handle, 1704067200 + doc_id * 60 AS t FROM documents"))
def coordinated_bursts(spark, sf):
    posts = fx.table(spark, sf, "documents").withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60))
    return K.coordinated_bursts(posts, "text", "source", "at").withColumns({c: F.unix_timestamp(c) for c in ("start", "end")})


@query("coordinated_link_bursts", _runs("host", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, page_id % 50 AS handle, 1704067200 + page_id * 97 AS t FROM pages"))
def coordinated_link_bursts(spark, sf):
    posts = fx.table(spark, sf, "pages").select(F.array("url", "url").alias("urls"), (F.col("page_id") % 50).alias("account"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 97).alias("at"))
    return K.link_bursts(posts, "urls", "account", "at").withColumns({c: F.unix_timestamp(c) for c in ("start", "end")})


@query("shared_infrastructure", "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, count(DISTINCT page_id % 50) AS n_accounts, count(*) AS n_urls FROM pages GROUP BY 1 HAVING count(DISTINCT page_id % 50) >= 2")
def shared_infrastructure(spark, sf):
    return K.shared_hosts(fx.table(spark, sf, "pages").withColumn("account", F.col("page_id") % 50), "url", "account")


@query("profile_signals", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS followers, count(*) AS following, round(count(*) FILTER (WHERE event_type = 'purchase') / greatest(count(*), 1), 9) AS ratio, greatest(date_diff('day', CAST(min(ts) AS DATE), DATE '2024-02-01'), 0) AS age_days FROM events GROUP BY 1")
def profile_signals(spark, sf):
    rows = fx.table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("followers"), F.count("*").alias("following"), F.to_date(F.min("ts")).alias("since"))
    rows = rows.withColumn("age_days", K.account_age(F.col("since"), F.lit("2024-02-01").cast("date"))).drop("since")
    return rows.withColumn("ratio", F.round(K.follower_ratio(F.col("followers"), F.col("following")), 9))


@query("risk_fusion", f"WITH {fx.SCORED} SELECT id, round((CASE WHEN doc_id % 4 = 0 THEN 0 ELSE p_scam * 2 END + p_topic) / (CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END + 1), 9) AS risk FROM scored")
def risk_fusion(spark, sf):
    text = F.when(F.col("doc_id") % 4 != 0, F.col("p_scam"))
    return fx.scored(spark, sf).select("id", F.round(K.risk_fusion({"text": (text, 2.0), "url": (F.col("p_topic"), 1.0)}), 9).alias("risk"))


@query("active_learning_queue", f"WITH {fx.SCORED} SELECT id, round(abs(p_scam - 0.5e0), 12) AS distance FROM scored ORDER BY abs(p_scam - 0.5e0), id LIMIT 40")
def active_learning_queue(spark, sf):
    return K.active_learning_queue(fx.scored(spark, sf), "p_scam", 0.5, 40, "id").select("id", F.round("distance", 12).alias("distance"))
