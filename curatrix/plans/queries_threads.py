"""Queries on files, threads, snapshots and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions.labels import CLASSES, TAXONOMY
from curatrix.operators import threads as H
from curatrix.operators import snapshots as N
from curatrix.operators import validation as V
from curatrix.plans import fixtures as fx
from curatrix.plans.catalog import query
from curatrix.sources import files as S
from curatrix.sources import stored as Z

_KNOWN = [label for labels in TAXONOMY.values() for label in labels]
_ONE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("read_posts_jsonl", f"WITH {fx.POSTS} SELECT id, md5(text) AS digest, array_to_string(labels, ',') AS labels FROM posts")
def read_posts_jsonl(spark, sf):
    path = S.shared_path(spark, "posts")
    S.write_posts(fx.posts(spark, sf).select("id", "text", "labels"), path)
    return S.read_posts(spark, path).select("id", F.md5("text").alias("digest"), F.concat_ws(",", "labels").alias("labels"))


@query("write_posts_jsonl", f"WITH {fx.POSTS}, s AS (SELECT {fx.split_sql()} AS split FROM posts) SELECT split, count(*) AS n FROM s GROUP BY 1")
def write_posts_jsonl(spark, sf):
    path = S.shared_path(spark, "posts")
    S.write_posts(fx.with_split(fx.posts(spark, sf)).select("id", "text", "labels", "split"), path, ["split"])
    return spark.read.schema("id string, split string").json(path).groupBy("split").agg(F.count("*").alias("n"))


@query("read_labeled_text", f"WITH {fx.POSTS} SELECT md5({_ONE}) AS digest, array_to_string(labels, ',') AS labels FROM posts WHERE len(labels) > 0")
def read_labeled_text(spark, sf):
    path = S.shared_path(spark, "labeled")
    S.write_labeled_text(fx.posts(spark, sf).select("labels", "text"), path)
    return S.read_labeled_text(spark, path).select(F.md5("text").alias("digest"), F.concat_ws(",", "labels").alias("labels"))


@query("read_labeled_text_classes", f"WITH {fx.POSTS} SELECT md5({_ONE}) AS digest, 'topic_crypto' AS labels FROM posts WHERE list_contains(labels, 'topic_crypto')")
def read_labeled_text_classes(spark, sf):
    path = S.shared_path(spark, "labeled")
    S.write_labeled_text(fx.posts(spark, sf).select("labels", "text"), path)
    return S.read_labeled_text(spark, path, CLASSES).select(F.md5("text").alias("digest"), F.concat_ws(",", "labels").alias("labels"))


@query("read_id_list", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents")
def read_id_list(spark, sf):
    path = S.shared_path(spark, "ids")
    id_ = F.col("doc_id").cast("string")
    docs = fx.table(spark, sf, "documents")
    docs.select(F.when(F.col("doc_id") % 5 == 0, F.to_json(F.struct(id_.alias("id"), "lang"))).otherwise(F.concat(F.lit("  "), id_, F.lit(" ")))).write.text(path)
    return S.read_id_list(spark, path)


@query("read_change_list", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN 'promo,scam' ELSE 'bogus' END AS new_labels, doc_id % 2 = 0 AS valid FROM documents")
def read_change_list(spark, sf):
    path = S.shared_path(spark, "changes")
    docs = fx.table(spark, sf, "documents")
    last = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, " promo ,scam # seen").otherwise(" bogus"))
    lines = F.array(F.concat(F.col("doc_id").cast("string"), F.lit(" clean")), F.lit("# a comment"), F.lit(""), last)
    docs.select(F.explode(lines)).write.text(path)
    return S.read_change_list(spark, path).withColumn("new_labels", F.concat_ws(",", "new_labels"))


@query("read_snapshots", "SELECT CAST(event_id AS VARCHAR) AS snapshot_id, CAST(user_id AS VARCHAR) AS post_id, event_type AS endpoint FROM events WHERE event_id % 10 <> 3")
def read_snapshots(spark, sf):
    return S.read_snapshots(_snapshot_lines(spark, sf)).select("snapshot_id", "post_id", "endpoint")


def _snapshot_lines(spark, sf):
    ev = fx.table(spark, sf, "events")
    users = F.array(F.struct(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("username")))
    note = F.when(F.col("event_id") % 4 == 0, F.struct(F.concat(F.lit("long "), F.col("event_id").cast("string")).alias("text")))
    data = F.struct(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"), F.col("user_id").cast("string").alias("author_id"), note.alias("note_tweet"), F.struct((F.col("event_id") % 100).alias("like_count")).alias("public_metrics"))
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("snapshot_id"), F.col("user_id").cast("string").alias("post_id"), F.col("event_type").alias("endpoint"), F.lit("2024-01-01").alias("retrieved_at"), F.struct(data.alias("data"), F.struct(users.alias("users")).alias("includes")).alias("raw")))
    return ev.select(F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken"), line)).otherwise(line).alias("value"), "event_id")


@query("snapshot_to_posts", "SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 4 = 0 THEN 'long ' ELSE 'text ' END || CAST(event_id AS VARCHAR) AS text, 'user' || CAST(user_id AS VARCHAR) AS handle, event_id % 100 AS likes FROM events WHERE event_id % 10 <> 3")
def snapshot_to_posts(spark, sf):
    return S.snapshot_to_posts(S.read_snapshots(_snapshot_lines(spark, sf))).select("id", "text", "handle", "likes")


_CHAIN = "event_id % 20 < 1 + (event_id // 20) % 20"


@query("snapshot_edit_chains", f"""WITH e AS (SELECT event_id, CASE WHEN {_CHAIN} THEN event_id // 20 * 20 ELSE event_id END AS root, CASE WHEN {_CHAIN} THEN event_id % 20 + 1 ELSE 1 END AS version, (event_id * 37) % 101 AS likes FROM events WHERE event_id IS NOT NULL)
SELECT CAST(event_id AS VARCHAR) AS id, CAST(root AS VARCHAR) AS root, CAST(version AS INTEGER) AS version, likes, likes - lag(likes) OVER (PARTITION BY root ORDER BY version) AS change_likes FROM e""")
def snapshot_edit_chains(spark, sf):
    """Chains of 1 to 20 versions; a snapshot tells its own id and the one before only."""
    ev = fx.table(spark, sf, "events").where("event_id is not null")
    here, own = F.expr("event_id % 20 < 1 + (event_id div 20) % 20 and event_id % 20 > 0"), F.col("event_id").cast("string")
    history = F.when(here, F.array((F.col("event_id") - 1).cast("string"), own)).otherwise(F.array(own))
    data = F.struct(own.alias("id"), history.alias("edit_history_tweet_ids"), F.struct((F.col("event_id") * 37 % 101).alias("like_count")).alias("public_metrics"))
    lines = ev.select(F.to_json(F.struct(own.alias("snapshot_id"), own.alias("post_id"), F.struct(data.alias("data")).alias("raw"))).alias("value"))
    posts = S.snapshot_to_posts(S.read_snapshots(lines)).select("id", "history", "likes")
    chains = N.edit_chains(posts)
    return N.metric_changes(posts.join(chains, "id").select("id", "root", "version", "likes"), "root", ["version"], ["likes"])


@query("snapshot_links", """SELECT CAST(event_id AS VARCHAR) AS id, 'url' AS kind, 'https://h' || CAST(event_id % 7 AS VARCHAR) || '.test/' || CAST(event_id AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS text FROM events WHERE event_id % 3 > 0
UNION ALL SELECT CAST(event_id AS VARCHAR), 'url', 'https://t.test/' || CAST(event_id AS VARCHAR), NULL FROM events WHERE event_id % 3 = 2
UNION ALL SELECT CAST(event_id AS VARCHAR), 'quoted', CAST(user_id AS VARCHAR), 'post of ' || CAST(user_id AS VARCHAR) FROM events WHERE event_id % 2 = 0
UNION ALL SELECT CAST(event_id AS VARCHAR), 'replied_to', CAST(event_id + 1 AS VARCHAR), NULL FROM events WHERE event_id % 5 = 0""")
def snapshot_links(spark, sf):
    """Urls of texts and long texts, repeated ones once, and references to posts that are included or aren't."""
    ev = fx.table(spark, sf, "events")
    own, m = F.col("event_id").cast("string"), lambda k: F.col("event_id") % k
    short = F.concat(F.lit("https://t.test/"), own)
    link = lambda expanded: F.struct(short.alias("url"), expanded.alias("expanded_url"))
    long = link(F.concat(F.lit("https://h"), m(7).cast("string"), F.lit(".test/"), own))
    note = F.when(m(3) == 2, F.struct(F.struct(F.array(long, link(F.lit(None).cast("string"))).alias("urls")).alias("entities")))
    refers = F.array_compact(F.array(F.when(m(2) == 0, F.struct(F.col("user_id").cast("string").alias("id"), F.lit("quoted").alias("type"))), F.when(m(5) == 0, F.struct((F.col("event_id") + 1).cast("string").alias("id"), F.lit("replied_to").alias("type")))))
    others = F.array(F.struct(F.col("user_id").cast("string").alias("id"), F.concat(F.lit("post of "), F.col("user_id").cast("string")).alias("text")))
    data = F.struct(own.alias("id"), F.when(m(3) > 0, F.struct(F.array(long, long).alias("urls"))).alias("entities"), note.alias("note_tweet"), refers.alias("referenced_tweets"))
    lines = ev.select(F.to_json(F.struct(own.alias("snapshot_id"), own.alias("post_id"), F.struct(data.alias("data"), F.struct(others.alias("tweets")).alias("includes")).alias("raw"))).alias("value"))
    posts = S.snapshot_to_posts(S.read_snapshots(lines))
    urls = posts.select("id", F.lit("url").alias("kind"), F.explode("urls").alias("target"), F.lit(None).cast("string").alias("text"))
    return urls.unionByName(posts.select("id", F.explode("refers").alias("r")).select("id", F.col("r.type").alias("kind"), F.col("r.id").alias("target"), "r.text"))


@query("write_report", f"WITH {fx.POSTS}, e AS (SELECT unnest(labels) AS label FROM posts) SELECT label, count(*) AS n FROM e GROUP BY 1")
def write_report(spark, sf):
    path = S.shared_path(spark, "report")
    S.write_report(fx.posts(spark, sf).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")), path, "csv")
    return spark.read.option("header", True).schema("label string, n long").csv(path)


@query("dataset_snapshot", """SELECT 'posts' AS snapshot_id, 1 AS number, 'documents' AS name, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_characters FROM documents
UNION ALL SELECT 'posts-v2', 2, 'documents', count(*), CAST(sum(length(text) + 1) AS BIGINT) FROM documents UNION ALL SELECT 'replies', 3, 'conversations', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations
UNION ALL SELECT 'replies', 3, 'documents', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents""")
def dataset_snapshot(spark, sf):
    """Stored, stored again in another order, changed under the same name, and two tables together; then the index, and rows read back."""
    root, docs, talk = S.shared_path(spark, "snapshots"), fx.table(spark, sf, "documents"), fx.table(spark, sf, "conversations")
    Z.append_snapshot(spark, root, "posts", {"documents": docs})
    Z.append_snapshot(spark, root, "posts", {"documents": docs.repartition("lang", "doc_id")})
    Z.append_snapshot(spark, root, "posts", {"documents": docs.withColumn("text", F.concat("text", F.lit(".")))})
    Z.append_snapshot(spark, root, "replies", {"documents": docs, "conversations": talk})
    Z.append_snapshot(spark, root, "others", {"conversations": talk.repartition("turn"), "documents": docs})
    index = Z.snapshot_index(spark, root).select("snapshot_id", F.col("number").cast("int").alias("number"), F.explode("tables").alias("t")).select("snapshot_id", "number", "t.name", "t.n_rows")
    out = None
    for entry in [("posts", "documents"), ("posts-v2", "documents"), ("replies", "conversations"), ("replies", "documents")]:
        sums = Z.read_snapshot(spark, root, *entry).agg(F.sum(F.length("text")).alias("n_characters"))
        one = sums.select(F.lit(entry[0]).alias("snapshot_id"), F.lit(entry[1]).alias("name"), "n_characters")
        out = one if out is None else out.unionByName(one)
    return index.join(out, ["snapshot_id", "name"], "full_outer")


def _payload(spark, sf):
    t = fx.turns(spark, sf)
    one = lambda name, back: t.select("conv_id", (F.col("turn") + back).alias("at"), F.struct("status_id", "handle", "text").alias(name))
    return one("callout", 0).join(one("reply", 1), ["conv_id", "at"], "left").join(one("original", 2), ["conv_id", "at"], "left")


_PAYLOAD = f"""{fx.TURNS}, payload AS (SELECT c.conv_id, c.status_id AS callout_id, lower(c.handle) AS callout_handle, c.text AS callout_text, r.status_id AS reply_id, coalesce(lower(r.handle), '') AS reply_handle, coalesce(r.text, '') AS reply_text,
  o.status_id AS original_id, coalesce(lower(o.handle), '') AS original_handle, coalesce(o.text, '') AS original_text FROM turns c LEFT JOIN turns r ON r.conv_id = c.conv_id AND r.turn = c.turn - 1 LEFT JOIN turns o ON o.conv_id = c.conv_id AND o.turn = c.turn - 2)"""


@query("flatten_callout_payload", f"WITH {_PAYLOAD} SELECT callout_id, callout_handle, reply_id, reply_handle, original_id, original_handle, md5(original_text) AS digest FROM payload")
def flatten_callout_payload(spark, sf):
    return H.flatten_callouts(_payload(spark, sf)).select("callout_id", "callout_handle", "reply_id", "reply_handle", "original_id", "original_handle", F.md5("original_text").alias("digest"))


@query("convert_callout_to_thread", f"WITH {_PAYLOAD} SELECT 'sample-' || reply_id AS id, concat_ws(',', CASE WHEN original_text <> '' THEN 'original_post' END, 'ai_reply', CASE WHEN callout_text <> '' THEN 'evidence' END) AS roles FROM payload WHERE reply_text <> '' AND reply_id IS NOT NULL")
def convert_callout_to_thread(spark, sf):
    out = H.convert_callouts(H.flatten_callouts(_payload(spark, sf)))
    return out.select("id", F.concat_ws(",", F.transform("posts", lambda p: p["role"])).alias("roles"))


@query("unify_threads", f"""WITH {_PAYLOAD}, c AS (SELECT conv_id, 'sample-' || reply_id AS id, reply_id FROM payload WHERE reply_text <> '' AND reply_id IS NOT NULL), e AS (SELECT id, reply_id FROM c WHERE conv_id % 3 = 0),
d AS (SELECT reply_id, id, 1 AS origin FROM c WHERE conv_id % 2 = 0 UNION ALL SELECT reply_id, id, 2 FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY reply_id ORDER BY origin) AS k FROM d WHERE reply_id NOT IN (SELECT reply_id FROM e))
SELECT id, 0 AS origin FROM e UNION ALL SELECT id, origin FROM r WHERE k = 1""")
def unify_threads(spark, sf):
    flat = H.flatten_callouts(_payload(spark, sf))
    conv = F.split_part("callout_id", F.lit("-"), F.lit(1)).cast("long")
    made = lambda rule: H.convert_callouts(flat.where(rule))
    return H.unify_threads(made(conv % 3 == 0).drop("reply_id"), [made(conv % 2 == 0), made(F.lit(True))]).select("id", "origin")


@query("fetch_coverage", f"WITH {_PAYLOAD} SELECT callout_handle, count(*) AS total, count(reply_id) AS with_reply, count(original_id) AS with_original FROM payload GROUP BY 1")
def fetch_coverage(spark, sf):
    return H.fetch_coverage(_payload(spark, sf).withColumn("callout_handle", F.lower("callout.handle")), "callout_handle")


def _threads(spark, sf):
    """Conversations as threads; every seventh lacks its first post."""
    return H.as_threads(fx.turns(spark, sf).where("not (conv_id % 7 = 0 and turn = 0)"), "conv_id")


@query("thread_parent_check", f"WITH {fx.TURNS}, t AS (SELECT * FROM turns WHERE NOT (conv_id % 7 = 0 AND turn = 0)) SELECT conv_id, parent_status_id AS unknown_parents FROM t WHERE parent_status_id NOT IN (SELECT status_id FROM t)")
def thread_parent_check(spark, sf):
    return H.parent_check(_threads(spark, sf), "conv_id").withColumn("unknown_parents", F.concat_ws(",", "unknown_parents"))


@query("reply_context", f"WITH {fx.TURNS} SELECT r.status_id, p.status_id AS parent_id, md5(p.text) AS parent_digest FROM turns r JOIN turns p ON r.parent_status_id = p.status_id")
def reply_context(spark, sf):
    return H.reply_context(fx.turns(spark, sf)).select("status_id", "parent_id", F.md5("parent_text").alias("parent_digest"))


_FLAGGED = "SELECT lower(handle) AS handle, count(*) AS n, array_to_string(list_sort(list_distinct(list('s' || CAST(conv_id % 3 AS VARCHAR)))), ',') AS sources, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM turns WHERE role = 'ai_reply' GROUP BY 1"


@query("flagged_accounts", f"WITH {fx.TURNS} {_FLAGGED}")
def flagged_accounts(spark, sf):
    rows = fx.turns(spark, sf).withColumn("source", F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")))
    return H.flagged_accounts(rows, "source", F.col("n") >= 3).withColumn("sources", F.concat_ws(",", "sources"))


@query("new_flagged_handles", f"WITH {fx.TURNS} SELECT DISTINCT lower(handle) AS handle FROM turns WHERE role = 'ai_reply' AND lower(handle) NOT IN (SELECT lower(handle) FROM turns WHERE conv_id % 4 = 0)")
def new_flagged_handles(spark, sf):
    t = fx.turns(spark, sf)
    return H.new_flagged(t.where("role = 'ai_reply'"), t.where("conv_id % 4 = 0"))


@query("truth_over_inferred", f"WITH {fx.TURNS} SELECT status_id AS reply_id, CASE WHEN conv_id % 2 = 0 THEN 'truth' ELSE 'inferred' END AS origin FROM turns")
def truth_over_inferred(spark, sf):
    t = fx.turns(spark, sf).withColumnRenamed("status_id", "reply_id")
    return H.truth_over_inferred(t.where("conv_id % 2 = 0"), t)


_BAD = """bad AS (SELECT doc_id AS line, CASE WHEN doc_id % 50 = 1 THEN NULL WHEN doc_id % 50 = 2 THEN 'odd id' WHEN doc_id % 50 = 3 THEN 'x_3' ELSE lpad(CAST(doc_id AS VARCHAR), 16, '1') END AS id, CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 31 = 1 THEN ' ' ELSE text END AS text,
  CASE WHEN doc_id % 29 = 0 THEN [] WHEN doc_id % 29 = 1 THEN ['scam', 'scam'] WHEN doc_id % 29 = 2 THEN ['nonsense'] ELSE ['clean'] END AS labels, CASE WHEN doc_id % 23 = 0 THEN lpad(CAST(doc_id AS VARCHAR), 17, '2') WHEN doc_id % 23 = 1 THEN 'abc' END AS source_id,
  CASE WHEN doc_id % 19 = 0 THEN 'fax' ELSE 'x' END AS platform, source FROM documents)"""


def _bad(spark, sf):
    m = lambda k: F.col("doc_id") % k
    number = F.col("doc_id").cast("string")
    labels = F.when(m(29) == 0, fx.no_labels()).when(m(29) == 1, F.array(F.lit("scam"), F.lit("scam"))).when(m(29) == 2, F.array(F.lit("nonsense"))).otherwise(F.array(F.lit("clean")))
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("line"), F.when(m(50) == 1, None).when(m(50) == 2, "odd id").when(m(50) == 3, "x_3").otherwise(F.lpad(number, 16, "1")).alias("id"), F.when(m(31) == 0, None).when(m(31) == 1, " ").otherwise(F.col("text")).alias("text"),
        labels.alias("labels"), F.when(m(23) == 0, F.lpad(number, 17, "2")).when(m(23) == 1, "abc").alias("source_id"), F.when(m(19) == 0, "fax").otherwise("x").alias("platform"), "source",
    )


def _union(rules: list[tuple[str, str, str]], key: str, table: str) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{s}' AS severity, '{n}' AS rule FROM {table} WHERE {c}" for s, n, c in rules)


@query("validate_posts", f"WITH {_BAD}, r AS (SELECT *, id IS NOT NULL AND count(*) OVER (PARTITION BY id) > 1 AS repeated FROM bad) " + _union([
    ("error", "labels missing", "len(labels) = 0"), ("error", "text missing", "text IS NULL"), ("error", "duplicate labels", "len(list_distinct(labels)) < len(labels)"), ("error", "unknown label", "list_contains(labels, 'nonsense')"),
    ("error", "source_id is not id", "regexp_matches(source_id, '^\\d{16,20}$') AND source_id <> id"), ("error", "id is not source_id", "regexp_matches(id, '^\\d{16,20}$') AND source_id = 'abc'"), ("error", "duplicate id", "repeated"),
    ("warning", "no id", "id IS NULL"), ("warning", "empty text", "trim(text) = ''"), ("warning", "form of id", "NOT regexp_matches(id, '^\\d{16,20}$|^x_\\d+(_dup\\d+)?$|^x_auto_\\d+$')"),
], "line", "r"))
def validate_posts(spark, sf):
    return V.validate_posts(_bad(spark, sf), _KNOWN)


@query("validate_json_types", _union([("warning", "blank line", "doc_id % 9 = 0"), ("error", "broken JSON", "doc_id % 9 = 1"), ("error", "id is not a string", "doc_id % 9 = 2"), ("error", "labels is not a list", "doc_id % 9 = 3")], "doc_id", "documents"))
def validate_json_types(spark, sf):
    m = F.col("doc_id") % 9
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.array("lang").alias("labels")))
    line = F.when(m == 0, "  ").when(m == 1, F.concat(F.lit("{"), good)).when(m == 2, F.to_json(F.struct(F.col("doc_id").alias("id"), F.array("lang").alias("labels")))).when(m == 3, F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("labels")))).otherwise(good)
    return V.json_types(fx.table(spark, sf, "documents").select("doc_id", line.alias("value")), "value", "doc_id")


@query("validate_threads", f"""WITH {fx.TURNS}, t AS (SELECT * FROM turns WHERE NOT (conv_id % 7 = 0 AND turn = 0)), c AS (SELECT conv_id, bool_or(role = 'ai_reply') AS has_reply, bool_or(parent_status_id IS NOT NULL AND parent_status_id NOT IN (SELECT status_id FROM t)) AS unknown, bool_or(trim(text) = '') AS blank FROM t GROUP BY 1)
""" + _union([("error", "no ai reply", "NOT has_reply"), ("error", "unknown parent", "unknown"), ("warning", "empty text", "blank"), ("warning", "form of status id", "true")], "conv_id", "c"))
def validate_threads(spark, sf):
    return V.validate_threads(_threads(spark, sf), "conv_id")


_ACCOUNTS = """accounts AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 40 = 0 THEN '' WHEN c_custkey % 40 = 1 THEN '@' || c_name WHEN c_custkey % 40 = 2 THEN 'Twice' || CAST(c_custkey % 3 AS VARCHAR) ELSE c_name END AS handle,
  CASE WHEN c_custkey % 11 = 0 THEN c_mktsegment ELSE 'bot' END AS category, CASE WHEN c_custkey % 13 = 0 THEN -1 ELSE 5 END AS followers, CASE WHEN c_custkey % 17 = 0 THEN 'urgent' WHEN c_custkey % 17 = 1 THEN NULL ELSE 'low' END AS priority FROM customer)"""


@query("validate_accounts", f"WITH {_ACCOUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(handle) ORDER BY line) > 1 AS again FROM accounts) " + _union([
    ("error", "no handle", "trim(handle) = ''"), ("error", "handle with @", "handle LIKE '@%'"), ("error", "unknown category", "category <> 'bot'"), ("error", "negative followers", "followers < 0"), ("error", "unknown priority", "priority = 'urgent'"), ("error", "duplicate handle", "again"),
], "line", "r"))
def validate_accounts(spark, sf):
    m = lambda k: F.col("c_custkey") % k
    handle = F.when(m(40) == 0, "").when(m(40) == 1, F.concat(F.lit("@"), "c_name")).when(m(40) == 2, F.concat(F.lit("Twice"), m(3).cast("string"))).otherwise(F.col("c_name"))
    rows = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("line"), handle.alias("handle"), F.when(m(11) == 0, F.col("c_mktsegment")).otherwise("bot").alias("category"), F.when(m(13) == 0, -1).otherwise(5).alias("followers"), F.when(m(17) == 0, "urgent").when(m(17) != 1, "low").alias("priority"))
    return V.validate_accounts(rows, "line")


@query("validate_schema", f"WITH {_BAD}, k AS (SELECT source, id IS NOT NULL AND text IS NOT NULL AND len(labels) > 0 AND len(list_distinct(labels)) = len(labels) AND NOT list_contains(labels, 'nonsense') AND platform = 'x' AS ok FROM bad) SELECT source, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS errors FROM k GROUP BY 1")
def validate_schema(spark, sf):
    return V.validate_schema(_bad(spark, sf), _KNOWN, "source")


@query("validate_manifests", """WITH f AS (SELECT source AS run_id, count(*) AS c, sum(strlen(text)) AS b FROM documents GROUP BY 1) SELECT run_id, 'file count' AS rule FROM f WHERE run_id = 'src1' UNION ALL SELECT run_id, 'total bytes' FROM f WHERE run_id = 'src2'
UNION ALL SELECT run_id, 'form of digest' FROM f WHERE run_id = 'src4' UNION ALL SELECT run_id, 'duplicate run' FROM f, range(2) WHERE run_id = 'src5'""")
def validate_manifests(spark, sf):
    docs = fx.table(spark, sf, "documents")
    digest = F.sha2("text", 256)
    files = docs.select(F.col("source").alias("run_id"), F.octet_length("text").alias("size_bytes"), F.when(F.col("source") == "src4", F.upper(digest)).otherwise(digest).alias("sha256"))
    stated = files.groupBy("run_id").agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"))
    stated = stated.withColumn("file_count", F.col("file_count") + F.when(F.col("run_id") == "src1", 1).otherwise(0)).withColumn("total_bytes", F.col("total_bytes") - F.when(F.col("run_id") == "src2", 1).otherwise(0))
    stated = stated.withColumn("c", F.explode(F.sequence(F.lit(1), F.when(F.col("run_id") == "src5", 2).otherwise(1)))).drop("c")
    return V.validate_manifests(files, stated)


@query("validate_run_index", """WITH f AS (SELECT source AS run_id FROM documents GROUP BY 1)
SELECT CASE WHEN run_id = 'src6' THEN 'ghost' ELSE run_id END AS run_id, rule FROM f JOIN (VALUES ('src1', 'index file count'), ('src2', 'index total bytes'), ('src3', 'not in the index'), ('src4', 'listed twice'), ('src4', 'listed twice'), ('src6', 'no such run')) r(k, rule) ON run_id = k
UNION ALL SELECT 'src6', 'not in the index' FROM f WHERE run_id = 'src6' UNION ALL SELECT NULL, 'run count'""")
def validate_run_index(spark, sf):
    """The index miscounts files of src1 and bytes of src2, lacks src3, has src4 twice, another name for src6, and claims a run too many."""
    docs, run = fx.table(spark, sf, "documents"), F.col("run_id")
    manifests = S.staged(docs.groupBy(F.col("source").alias("run_id")).agg(F.count("*").alias("file_count"), F.sum(F.octet_length("text")).alias("total_bytes")), "manifests")
    index = manifests.where(run != "src3").select(F.when(run == "src6", "ghost").otherwise(run).alias("run_id"), (F.col("file_count") + (run == "src1").cast("int")).alias("file_count"), (F.col("total_bytes") - (run == "src2").cast("int")).alias("total_bytes"))
    index = index.unionByName(index.where("run_id = 'src4'").withColumn("file_count", F.lit(None).cast("long")))
    return V.validate_run_index(index, manifests, index.count() + 1)
