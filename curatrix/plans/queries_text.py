"""Queries on texts, labels and rule flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import labels as L
from curatrix.functions import scores as S
from curatrix.functions import text as X
from curatrix.operators import pages, rules
from curatrix.plans import fixtures as fx
from curatrix.plans.catalog import query

_SCAM = ", ".join(f"'{x}'" for x in L.SCAM_LABELS)
_CLEANED = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query("clean_text", f"SELECT doc_id, md5({_CLEANED}) AS digest, CAST(length({_CLEANED}) AS BIGINT) AS n FROM documents")
def clean_text(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text"), normalize=False).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("clean_text_nfkc")
def clean_text_nfkc(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text"), strip_urls=True, ignore_case=True).alias("t"))
    return docs.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("coalesce_text", "SELECT doc_id, md5(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = 0 THEN NULL ELSE text END, ''), nullif(lang, ''), '')) AS digest FROM documents")
def coalesce_text(spark, sf):
    df = fx.table(spark, sf, "documents").withColumn("t", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("text")))
    return df.select("doc_id", F.md5(X.coalesce_text("t", "lang")).alias("digest"))


_LEGACY = """legacy AS (
  SELECT id, CASE WHEN doc_id % 3 <> 0 THEN list_transform(labels, lambda x: ' ' || upper(x) || ' ') END AS labels,
         CASE WHEN doc_id % 4 = 0 THEN ' Crypto' WHEN doc_id % 4 = 1 THEN 'PHISHING' WHEN doc_id % 4 = 2 THEN ' ' END AS label FROM posts)"""


def _legacy(spark, sf):
    df = fx.posts(spark, sf)
    listed = F.when(F.col("doc_id") % 3 != 0, F.transform("labels", lambda x: F.concat(F.lit(" "), F.upper(x), F.lit(" "))))
    single = F.when(F.col("doc_id") % 4 == 0, " Crypto").when(F.col("doc_id") % 4 == 1, "PHISHING").when(F.col("doc_id") % 4 == 2, " ")
    return df.select("id", listed.alias("labels"), single.alias("label"))


_RAW1 = "list_filter(list_transform(CASE WHEN labels IS NOT NULL THEN labels ELSE [label] END, lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')"
_RAW2 = "list_filter(list_transform(list_concat(coalesce(labels, []), [label]), lambda x: lower(trim(x))), lambda x: x IS NOT NULL AND x <> '')"


@query("raw_labels", f"WITH {fx.POSTS}, {_LEGACY} SELECT id, array_to_string({_RAW1}, ',') AS raw FROM legacy")
def raw_labels(spark, sf):
    return _legacy(spark, sf).select("id", F.concat_ws(",", L.raw_labels()).alias("raw"))


@query("raw_labels_union", f"WITH {fx.POSTS}, {_LEGACY} SELECT id, array_to_string(list_sort(list_distinct({_RAW2})), ',') AS raw FROM legacy")
def raw_labels_union(spark, sf):
    return _legacy(spark, sf).select("id", F.concat_ws(",", F.array_sort(L.raw_labels(mode="union"))).alias("raw"))


@query("collapse_label", f"""WITH {fx.POSTS}, {_LEGACY}, r AS (SELECT id, {_RAW2} AS raw FROM legacy)
SELECT id, CASE WHEN list_has_any(raw, [{_SCAM}]) THEN 'scam' WHEN list_has_any(raw, ['topic_crypto', 'crypto']) THEN 'topic_crypto' ELSE 'clean' END AS label FROM r""")
def collapse_label(spark, sf):
    return _legacy(spark, sf).select("id", L.collapse_label(L.raw_labels(mode="union")).alias("label"))


@query("multi_labels", f"""WITH {fx.POSTS}, {_LEGACY}, r AS (SELECT id, {_RAW2} AS raw FROM legacy)
SELECT id, coalesce(nullif(concat_ws(',', CASE WHEN list_has_any(raw, [{_SCAM}]) THEN 'scam' END, CASE WHEN list_has_any(raw, ['topic_crypto', 'crypto']) THEN 'topic_crypto' END), ''), 'clean') AS labels FROM r""")
def multi_labels(spark, sf):
    return _legacy(spark, sf).select("id", F.concat_ws(",", L.multi_labels(L.raw_labels(mode="union"))).alias("labels"))


@query("training_targets", f"""WITH {fx.POSTS}, {_LEGACY}, r AS (SELECT id, {_RAW2} AS raw FROM legacy)
SELECT id, CASE WHEN list_has_any(raw, [{_SCAM}]) THEN 'scam' WHEN list_has_any(raw, ['topic_crypto', 'crypto']) THEN 'topic_crypto' ELSE 'clean' END AS collapsed,
       CAST(list_has_any(raw, [{_SCAM}]) AS BIGINT) AS y_scam, CAST(list_has_any(raw, ['topic_crypto', 'crypto']) AS BIGINT) AS y_crypto FROM r""")
def training_targets(spark, sf):
    df = _legacy(spark, sf).select("id", L.training_targets(L.raw_labels(mode="union"), ["topic_crypto"]).alias("t"))
    return df.select("id", "t.collapsed", F.col("t.y_scam").cast("long").alias("y_scam"), F.col("t.y_topics")[0].cast("long").alias("y_crypto"))


@query("normalize_change_labels", """WITH c AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'clean' END, CASE WHEN doc_id % 3 = 0 THEN 'crypto_scam' END,
  CASE WHEN doc_id % 5 = 0 THEN 'promo' END, CASE WHEN doc_id % 7 = 0 THEN 'unknown' END, CASE WHEN doc_id % 11 = 0 THEN 'crypto' END], lambda x: x IS NOT NULL) AS l FROM documents),
k AS (SELECT doc_id, list_filter(['clean', 'promo', 'scam', 'topic_crypto'], lambda x: (x = 'clean' AND doc_id % 2 = 0) OR (x = 'promo' AND doc_id % 5 = 0)
  OR (x = 'scam' AND doc_id % 3 = 0) OR (x = 'topic_crypto' AND (doc_id % 3 = 0 OR doc_id % 11 = 0))) AS l FROM c)
SELECT doc_id, array_to_string(CASE WHEN len(l) > 1 THEN list_filter(l, lambda x: x <> 'clean') ELSE l END, ',') AS labels FROM k""")
def normalize_change_labels(spark, sf):
    pick = lambda k, name: F.when(F.col("doc_id") % k == 0, F.lit(name))
    given = F.array_compact(F.array(pick(2, "clean"), pick(3, "crypto_scam"), pick(5, "promo"), pick(7, "unknown"), pick(11, "crypto")))
    return fx.table(spark, sf, "documents").select("doc_id", F.concat_ws(",", F.array_sort(L.normalize_change_labels(given))).alias("labels"))


@query("author_handle", "SELECT c_custkey, lower(coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN NULL ELSE c_name END), ''), nullif(trim(c_mktsegment), ''))) AS handle FROM customer")
def author_handle(spark, sf):
    df = fx.table(spark, sf, "customer").withColumn("first", F.when(F.col("c_custkey") % 3 == 0, "  ").when(F.col("c_custkey") % 3 == 2, F.col("c_name")))
    return df.select("c_custkey", X.author_handle("first", "c_mktsegment").alias("handle"))


@query("has_url", "SELECT page_id, regexp_matches(html, '(?i)https?://\\S+|www\\.\\S+') AS in_html, regexp_matches(url, '(?i)https?://\\S+|www\\.\\S+') AS in_url FROM pages")
def has_url(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", X.has_url(F.col("html")).alias("in_html"), X.has_url(F.col("url")).alias("in_url"))


@query("prepare_records", f"""WITH {fx.POSTS}, {fx.scored_sql()}
SELECT id, md5({_CLEANED}) AS text_digest, gold AS collapsed, CAST(gold_scam AS BIGINT) AS y_scam, CAST(gold_topic AS BIGINT) AS y_topic, source AS handle,
       regexp_matches(text, '(?i)https?://\\S+|www\\.\\S+') AS has_url FROM scored WHERE {_CLEANED} <> ''""")
def prepare_records(spark, sf):
    df = fx.scored(spark, sf).withColumn("cleaned", X.clean_text(F.col("text"), normalize=False))
    kept = rules.drop_empty(df, "cleaned")
    return kept.select(F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("row_"), F.xxhash64("cleaned"))).alias("id"), F.md5("cleaned").alias("text_digest"), F.col("gold").alias("collapsed"),
                       F.col("gold_scam").cast("long").alias("y_scam"), F.col("gold_topic").cast("long").alias("y_topic"), X.author_handle("source").alias("handle"), X.has_url(F.col("text")).alias("has_url"))


@query("parse_time", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS at FROM orders""")
def parse_time(spark, sf):
    df = fx.table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, "not a time").when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return df.select("o_orderkey", F.date_format(X.parse_time(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("feature_tokens", f"""WITH {fx.POSTS}, s AS (SELECT id, list_sort(labels) AS l FROM posts)
SELECT id, array_to_string(list_concat(list_transform(l, lambda x: 'L:' || x), flatten(list_transform(range(1, len(l) + 1), lambda i: list_transform(l[i + 1:], lambda b: 'P:' || l[i] || '|' || b)))), ' ') AS tokens FROM s""")
def feature_tokens(spark, sf):
    return fx.posts(spark, sf).select("id", F.concat_ws(" ", L.feature_tokens(F.col("labels"))).alias("tokens"))


@query("confidence_band", f"WITH {fx.SCORED} SELECT CASE WHEN p_scam >= 0.95e0 OR p_scam <= 0.05e0 THEN 'high' WHEN p_scam >= 0.80e0 OR p_scam <= 0.20e0 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM scored GROUP BY 1")
def confidence_band(spark, sf):
    return fx.scored(spark, sf).groupBy(S.confidence_band(F.col("p_scam")).alias("band")).agg(F.count("*").alias("n"))


@query("clamp_probability", f"WITH {fx.SCORED}, x AS (SELECT id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 'nan'::DOUBLE WHEN doc_id % 6 = 2 THEN 'inf'::DOUBLE ELSE p_scam * 3 - 1 END AS p FROM scored) SELECT id, CASE WHEN p IS NULL OR NOT isfinite(p) THEN 0e0 ELSE greatest(0e0, least(1e0, p)) END AS p FROM x")
def clamp_probability(spark, sf):
    m = F.col("doc_id") % 6
    p = F.when(m == 0, None).when(m == 1, float("nan")).when(m == 2, float("inf")).otherwise(F.col("p_scam") * 3 - 1)
    return fx.scored(spark, sf).select("id", S.clamp_probability(p).alias("p"))


@query("softmax_sigmoid", f"WITH {fx.SCORED} SELECT id, round(1 / (1 + exp((1 - p_scam) * 8 - p_scam * 8)), 9) AS scam_prob, round(1 / (1 + exp(-(p_topic * 20 - 10))), 9) AS topic_prob FROM scored")
def softmax_sigmoid(spark, sf):
    logits = F.array((1 - F.col("p_scam")) * 8, F.col("p_scam") * 8)
    return fx.scored(spark, sf).select("id", F.round(S.softmax2(logits), 9).alias("scam_prob"), F.round(S.sigmoid(F.col("p_topic") * 20 - 10), 9).alias("topic_prob"))


@query("text_gate", "WITH g AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(substr(t, 1, 800)) AS digest, CAST(least(length(t), 800) AS BIGINT) AS n FROM g WHERE length(t) >= 20")
def text_gate(spark, sf):
    df = fx.table(spark, sf, "documents").select("doc_id", X.text_gate(F.col("text")).alias("t")).where("t is not null")
    return df.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("preview_text", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents")
def preview_text(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", X.preview_text(F.col("text")).alias("preview"))


@query("extract_page_blocks")
def extract_page_blocks(spark, sf):
    return pages.page_blocks(fx.table(spark, sf, "pages"), "page_id", "html")


@query("to_publishable_rows", f"""WITH {fx.POSTS} SELECT id, 'x' AS platform, array_to_string(labels, ',') AS labels, CASE WHEN list_contains(labels, 'topic_crypto') THEN '1' ELSE '' END AS label_ids FROM posts""")
def to_publishable_rows(spark, sf):
    df = fx.posts(spark, sf).withColumn("label", F.lit(None).cast("string")).withColumn("p", L.publishable())
    return df.select("id", F.lit("x").alias("platform"), F.concat_ws(",", "p.labels").alias("labels"), F.concat_ws(",", F.transform("p.label_ids", lambda x: x.cast("string"))).alias("label_ids"))


@query("labels_dim", "WITH " + fx.POSTS + """, dim(label, label_group) AS (VALUES ('phishing', 'security_fraud'), ('low_effort', 'spam_manipulation_commercial'), ('topic_crypto', 'topic_filters_optional')),
e AS (SELECT unnest(labels) AS label FROM posts) SELECT label_group, count(*) AS n FROM e JOIN dim USING (label) GROUP BY 1""")
def labels_by_group(spark, sf):
    used = fx.posts(spark, sf).select(F.explode("labels").alias("label"))
    return used.join(F.broadcast(L.labels_dim(spark)), "label").groupBy("label_group").agg(F.count("*").alias("n"))


@query("drop_empty", f"SELECT count(*) FILTER (WHERE {_CLEANED} <> '') AS kept, count(*) FILTER (WHERE {_CLEANED} = '') AS dropped FROM documents")
def drop_empty(spark, sf):
    empty = X.clean_text(F.col("text"), normalize=False) == ""
    return fx.table(spark, sf, "documents").agg(F.count_if(~empty).alias("kept"), F.count_if(empty).alias("dropped"))


@query("exclude_labels", f"WITH {fx.POSTS}, k AS (SELECT id, labels, list_filter(labels, lambda x: x <> 'low_effort') AS l FROM posts) SELECT id, array_to_string(l, ',') AS labels, list_contains(labels, 'low_effort') AS changed FROM k WHERE len(l) > 0")
def exclude_labels(spark, sf):
    return rules.exclude_labels(fx.posts(spark, sf), ["low_effort"]).select("id", F.concat_ws(",", "labels").alias("labels"), "changed")


@query("exclusion_count", f"WITH {fx.POSTS}, k AS (SELECT labels, list_filter(labels, lambda x: x <> 'low_effort') AS l FROM posts) SELECT count(*) FILTER (WHERE list_contains(labels, 'low_effort') OR len(l) = 0) AS removed, count(*) FILTER (WHERE len(l) > 0) AS kept, count(*) AS n_rows FROM k")
def exclusion_count(spark, sf):
    return rules.exclusion_count(fx.posts(spark, sf), ["low_effort"])


@query("pure_clean", f"WITH {fx.SCORED} SELECT id FROM scored WHERE gold_scam = 0 AND gold_topic = 0")
def pure_clean(spark, sf):
    return rules.pure_clean(fx.scored(spark, sf), "multi").select("id")


_TERMS = rules.alternation(rules.CRYPTO_TERMS)


@query("suggest_relabel", f"""WITH {fx.SCORED}, r AS (SELECT id, concat_ws(', ', 'keyword:' || nullif(lower(regexp_extract(text, '(?i)\\b({_TERMS})\\b', 1)), ''),
  CASE WHEN regexp_matches(text, '\\$[A-Za-z]{{2,10}}\\b') THEN 'ticker_pattern' END, CASE WHEN regexp_matches(text, '\\b0x[a-fA-F0-9]{{40}}\\b') THEN 'eth_address' END,
  CASE WHEN regexp_matches(text, '(?i)\\bbags?\\b') AND NOT regexp_matches(text, '(?i)\\b({"|".join(rules.PLAIN_BAGS)})\\b') THEN 'crypto_bags_slang' END) AS reason
  FROM scored WHERE gold_scam = 0 AND gold_topic = 0) SELECT id, reason FROM r WHERE reason <> ''""")
def suggest_relabel(spark, sf):
    df = fx.scored(spark, sf).withColumn("addresses", fx.no_labels())
    return rules.suggest_relabel(df, labels="multi").select("id", "reason")


@query("min_chars_filter", f"SELECT doc_id FROM documents WHERE length({_CLEANED}) >= 8")
def min_chars_filter(spark, sf):
    return rules.min_chars(fx.table(spark, sf, "documents").withColumn("t", X.clean_text(F.col("text"), normalize=False)), "t").select("doc_id")


@query("subgroup_flags", f"""WITH {fx.POSTS}, t AS (SELECT *, {fx.split_sql()} AS split FROM posts), h AS (SELECT DISTINCT lang FROM t WHERE split = 'train' AND lang <> 'es'),
f AS (SELECT t.doc_id, length(t.text) < 40 AS short, regexp_matches(t.text, '(?i)https?://\\S+|www\\.\\S+') AS url, h.lang IS NOT NULL AS seen FROM t LEFT JOIN h ON t.lang = h.lang)
SELECT 'all' AS subgroup, count(*) AS n FROM f UNION ALL SELECT 'short', count(*) FILTER (WHERE short) FROM f HAVING count(*) FILTER (WHERE short) > 0
UNION ALL SELECT CASE WHEN url THEN 'with_url' ELSE 'without_url' END, count(*) FROM f GROUP BY 1 UNION ALL SELECT CASE WHEN seen THEN 'seen_handle' ELSE 'unseen_handle' END, count(*) FROM f GROUP BY 1""")
def subgroup_flags(spark, sf):
    # flags are told where a text is read, and counted before rows of a language meet: no text is moved
    docs = fx.with_split(fx.table(spark, sf, "documents")).select("doc_id", "lang", "split", (F.length("text") < 40).alias("short"), X.has_url(F.col("text")).alias("url"))
    rows = docs.join(fx.table(spark, sf, "labels").select("doc_id"), "doc_id", "left")
    seen = docs.where("split = 'train' and lang <> 'es'").select("lang").distinct().withColumn("seen", F.lit(True))
    counts = rows.groupBy("lang", "short", "url").agg(F.count("*").alias("n")).join(seen, "lang", "left")
    flagged = counts.select("n", F.explode(rules.subgroups(F.col("short"), F.col("url"), F.col("seen"))).alias("subgroup"))
    return flagged.groupBy("subgroup").agg(F.sum("n").alias("n"))
