"""Queries on joins, counts, drift and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import labels as L
from curatrix.operators import counts as C
from curatrix.operators import joins as J
from curatrix.plans import fixtures as fx
from curatrix.plans.catalog import query
from curatrix.sources import files as S
from curatrix.sources import stored as Z

_SPLITS = [name for name, _ in fx.SPLITS]


def _splits(spark, sf):
    """Rows keyed by a digest of the text, so that splits share some."""
    df = fx.with_split(fx.posts(spark, sf))
    return df.withColumn("id", F.substring(F.md5("text"), 1, 16))


SPLIT_ROWS = f"{fx.POSTS}, split_rows AS (SELECT doc_id, substr(md5(text), 1, 16) AS id, text, lang, source, labels, collected_at, {fx.split_sql()} AS split FROM posts)"


@query("split_leakage", f"""WITH {SPLIT_ROWS}, s AS (SELECT DISTINCT id, split FROM split_rows),
names(n) AS (VALUES ('train'), ('valid'), ('calib'), ('holdout')), pairs AS (SELECT x.n AS a, y.n AS b FROM names x JOIN names y ON x.n < y.n),
f AS (SELECT x.split AS a, y.split AS b, count(*) AS shared FROM s x JOIN s y ON x.id = y.id AND x.split < y.split GROUP BY 1, 2)
SELECT a, b, coalesce(shared, 0) AS shared FROM pairs LEFT JOIN f USING (a, b)""")
def split_leakage(spark, sf):
    return J.split_leakage(_splits(spark, sf), _SPLITS)


@query("forbidden_overlap", f"""WITH {SPLIT_ROWS}, prev AS (SELECT DISTINCT id FROM split_rows WHERE {fx.split_sql(salt='prev')} = 'valid')
SELECT source, count(*) AS n_rows, count(prev.id) AS overlap FROM split_rows h LEFT JOIN prev ON h.id = prev.id WHERE split = 'holdout' GROUP BY 1""")
def forbidden_overlap(spark, sf):
    rows = _splits(spark, sf)
    return J.forbidden_overlap(rows.where("split = 'holdout'"), fx.with_split(rows.drop("split"), "prev").where("split = 'valid'"))


@query("calib_pool_candidates", f"""WITH {SPLIT_ROWS} SELECT doc_id FROM split_rows WHERE split = 'train' AND len(labels) = 0
AND text NOT IN (SELECT text FROM split_rows WHERE split IN ('calib', 'holdout'))""")
def calib_pool_candidates(spark, sf):
    rows = _splits(spark, sf)
    pool = rows.where("split = 'train' and size(labels) = 0")
    return J.calib_pool_candidates(pool, rows.where("split = 'calib'"), rows.where("split = 'holdout'")).select("doc_id")


_CHANGES = """changes AS (SELECT CAST(doc_id + CASE WHEN doc_id % 26 = 0 THEN 1000000000 ELSE 0 END AS VARCHAR) AS id,
  CASE WHEN doc_id % 39 = 0 THEN 'crypto_scam' WHEN doc_id % 2 = 1 THEN 'scam' ELSE 'bogus' END AS l FROM documents WHERE doc_id % 13 = 0)"""


def _changes(spark, sf):
    ids = F.col("doc_id") + F.when(F.col("doc_id") % 26 == 0, 1000000000).otherwise(0)
    label = F.when(F.col("doc_id") % 39 == 0, "crypto_scam").when(F.col("doc_id") % 2 == 1, "scam").otherwise("bogus")
    return fx.table(spark, sf, "documents").where("doc_id % 13 = 0").select(ids.cast("string").alias("id"), F.array(label).alias("new_labels"))


@query("apply_relabels", f"""WITH {fx.POSTS}, {_CHANGES}, c AS (SELECT id, CASE l WHEN 'crypto_scam' THEN 'topic_crypto,scam' WHEN 'scam' THEN 'scam' END AS new FROM changes)
SELECT p.id, coalesce(new, array_to_string(labels, ',')) AS labels, new IS NOT NULL AND new <> array_to_string(labels, ',') AS changed FROM posts p LEFT JOIN c ON p.id = c.id""")
def apply_relabels(spark, sf):
    return J.apply_relabels(fx.posts(spark, sf), _changes(spark, sf)).select("id", F.concat_ws(",", "labels").alias("labels"), "changed")


@query("relabels_not_found", f"WITH {_CHANGES} SELECT id FROM changes WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)")
def relabels_not_found(spark, sf):
    return J.relabels_not_found(fx.posts(spark, sf), _changes(spark, sf)).select("id")


@query("align_predictions", f"WITH {fx.SCORED} SELECT g.id, g.gold, s.p_scam FROM gold g JOIN scored s ON g.id = s.id WHERE s.doc_id % 3 <> 0")
def align_predictions(spark, sf):
    df = fx.scored(spark, sf)
    return J.align_predictions(df.select("id", "gold"), df.where("doc_id % 3 <> 0").select("id", "p_scam"))


@query("cache_coverage", "SELECT count(*) AS missing, min(CAST(doc_id AS VARCHAR)) AS first_missing FROM documents WHERE doc_id % 7 = 3")
def cache_coverage(spark, sf):
    df = fx.posts(spark, sf)
    return J.cache_coverage(df, df.where("doc_id % 7 <> 3"))


@query("seen_handles", f"WITH {SPLIT_ROWS} SELECT doc_id, coalesce(source IN (SELECT source FROM split_rows WHERE split = 'calib' AND source IS NOT NULL), false) AS seen FROM split_rows WHERE split = 'holdout'")
def seen_handles(spark, sf):
    rows = _splits(spark, sf)
    return J.flag_seen(rows.where("split = 'holdout'"), rows.where("split = 'calib'"), "source").select("doc_id", "seen")


@query("pending_callouts", f"WITH {fx.TURNS} SELECT status_id FROM turns WHERE lower(handle) NOT IN (SELECT lower(handle) FROM turns WHERE conv_id % 11 = 0)")
def pending_callouts(spark, sf):
    df = fx.turns(spark, sf)
    return J.pending(df, df.where("conv_id % 11 = 0").select(F.upper("handle").alias("handle")), "handle", ignore_case=True).select("status_id")


@query("manifest_reconcile", f"""WITH {SPLIT_ROWS}, a AS (SELECT source AS run_id, count(*) + CASE WHEN source = 'src2' THEN 1 ELSE 0 END AS n FROM split_rows WHERE source <> 'src1' GROUP BY source),
b AS (SELECT source AS run_id, count(*) AS n FROM split_rows WHERE source <> 'src3' GROUP BY source)
SELECT coalesce(a.run_id, b.run_id) AS run_id, CASE WHEN b.run_id IS NULL THEN 'missing' WHEN a.run_id IS NULL THEN 'extra' WHEN a.n <> b.n THEN 'n differs' ELSE 'ok' END AS status FROM a FULL OUTER JOIN b ON a.run_id = b.run_id""")
def manifest_reconcile(spark, sf):
    rows = fx.posts(spark, sf)
    index = rows.where("source <> 'src1'").groupBy(F.col("source").alias("run_id")).agg((F.count("*") + F.max(F.when(F.col("source") == "src2", 1).otherwise(0))).alias("n"))
    actual = rows.where("source <> 'src3'").groupBy(F.col("source").alias("run_id")).agg(F.count("*").alias("n"))
    return J.reconcile(index, actual, "run_id", ["n"])


_AUDITED = """b AS (SELECT doc_id // 16 AS b, string_agg(coalesce(text, '') || CASE WHEN doc_id // 16 % 10 = 2 THEN ' ' ELSE chr(10) END, '' ORDER BY doc_id) || CASE WHEN doc_id // 16 % 10 = 1 THEN 'x' ELSE '' END AS content FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT b % 10 AS r, CASE WHEN b % 10 = 6 THEN 'model/' ELSE 'data/' END || CAST(b AS VARCHAR) || '.bin' AS path, strlen(content) AS length, sha256(content) AS sha256 FROM b),
p AS (SELECT path, 'missing' AS problem FROM f WHERE r = 3 UNION ALL SELECT path, 'untracked' FROM f WHERE r = 4 UNION ALL SELECT path, 'size differs' FROM f WHERE r = 1 UNION ALL SELECT path, 'digest differs' FROM f WHERE r IN (1, 2)
UNION ALL SELECT path, 'too large' FROM f WHERE r = 6 AND length > 20000 UNION ALL SELECT '../' || path, 'bad path' FROM f WHERE r = 5)"""


@query("file_audit", f"WITH {_AUDITED} SELECT p.path, problem, f.length, f.sha256 FROM p LEFT JOIN f ON p.path = f.path AND r <> 3")
def file_audit(spark, sf):
    """All texts as files of 16; the manifest is of what was written. Then files change, are added and left out, and what lies there is read."""
    root, kept = S.shared_path(spark, "audited"), F.col("b") % 10
    docs = fx.table(spark, sf, "documents").where("doc_id is not null").withColumn("b", F.expr("doc_id div 16"))
    place = F.concat(F.when(kept == 6, "model/").otherwise("data/"), F.col("b").cast("string"), F.lit(".bin"))
    rows = docs.select("b", place.alias("path"), F.col("doc_id").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    first = Z.write_files(rows.withColumn("content", F.concat("text", F.lit("\n"))).where(kept != 3), root)
    # some are written again: of the same size with other bytes, or with a byte more
    more = rows.groupBy("b", "path").agg((F.max("part") + 1).alias("part"), F.lit("x").alias("content")).where(kept == 1)
    Z.write_files(rows.where(kept.isin(1, 2)).select("b", "path", "part", F.concat("text", F.when(kept == 2, " ").otherwise("\n")).alias("content")).unionByName(more, allowMissingColumns=True), root)
    numbered = first.withColumn("b", F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long")).where(kept != 4)
    told = numbered.select("path", F.col("length").alias("size_bytes"), "sha256")
    lost = rows.where(kept == 3).select("path").distinct().select("path", F.lit(1).cast("long").alias("size_bytes"), F.lit("").alias("sha256"))
    outside = numbered.where(kept == 5).select(F.concat(F.lit("../"), "path").alias("path"), F.col("length").alias("size_bytes"), "sha256")
    files = S.staged(Z.file_digests(spark, root), "digests")
    found = Z.audit_files(told.unionByName(lost).unionByName(outside), files, largest=20_000)
    return found.join(files, "path", "left").select("path", "problem", "length", "sha256")


@query("label_counts", f"WITH {SPLIT_ROWS}, e AS (SELECT split, unnest(labels) AS label FROM split_rows) SELECT split, label, count(*) AS n FROM e GROUP BY ALL")
def label_counts(spark, sf):
    return C.label_counts(_splits(spark, sf))


@query("mapping_stats", f"""WITH {fx.POSTS}, {fx.scored_sql()} SELECT count(*) FILTER (WHERE len(labels) = 0) AS unlabelled_to_clean, count(*) FILTER (WHERE len(labels) > 0 AND gold = 'clean') AS other_to_clean,
count(*) FILTER (WHERE coalesce(text, '') = '') AS skipped_empty, count(*) AS n_rows FROM scored""")
def mapping_stats(spark, sf):
    return C.mapping_stats(fx.posts(spark, sf), F.col("labels"), L.collapse_label(F.col("labels")), F.col("text"))


_RATES = f"""{fx.SCORED}, t AS (SELECT {fx.split_sql()} AS split, CASE WHEN gold_scam = 0 AND gold_topic = 0 THEN ['L:clean'] WHEN gold_scam = 0 THEN ['L:topic_crypto'] WHEN gold_topic = 0 THEN ['L:scam']
  ELSE ['L:scam', 'L:topic_crypto', 'P:scam|topic_crypto'] END AS tokens FROM scored), e AS (SELECT split, unnest(tokens) AS token FROM t),
sizes AS (SELECT split, count(*) AS n_rows FROM t GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM t), c AS (SELECT split, token, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT NULL, token, count(*) FROM e GROUP BY 2),
names AS (SELECT token FROM e UNION SELECT unnest(['L:clean', 'L:topic_crypto', 'L:scam'])),
rates AS (SELECT s.split, m.token, coalesce(c.n, 0) AS n, s.n_rows, coalesce(c.n, 0) / s.n_rows AS rate FROM sizes s CROSS JOIN names m LEFT JOIN c ON c.split IS NOT DISTINCT FROM s.split AND c.token = m.token)"""


def _rates(spark, sf):
    return C.token_rates(fx.with_split(fx.scored(spark, sf)), "multi")


@query("label_rates", f"WITH {_RATES} SELECT coalesce(split, 'all') AS split, token, n, n_rows, round(rate, 9) AS rate FROM rates WHERE token LIKE 'L:%'")
def label_rates(spark, sf):
    return _rates(spark, sf).where("token like 'L:%'").select(F.coalesce("split", F.lit("all")).alias("split"), "token", "n", "n_rows", F.round("rate", 9).alias("rate"))


@query("pair_rates", f"WITH {_RATES} SELECT coalesce(split, 'all') AS split, token, n, n_rows, round(rate, 9) AS rate FROM rates WHERE token LIKE 'P:%'")
def pair_rates(spark, sf):
    return _rates(spark, sf).where("token like 'P:%'").select(F.coalesce("split", F.lit("all")).alias("split"), "token", "n", "n_rows", F.round("rate", 9).alias("rate"))


@query("split_drift", f"""WITH {_RATES}, d AS (SELECT r.split, CASE WHEN r.token LIKE 'L:%' THEN 'label' ELSE 'pair' END AS kind, max(abs(r.rate - g.rate)) AS drift FROM rates r JOIN rates g ON g.split IS NULL AND g.token = r.token WHERE r.split IS NOT NULL GROUP BY ALL)
SELECT split, kind, round(drift, 9) AS drift, drift <= CASE kind WHEN 'label' THEN 0.03e0 ELSE 0.05e0 END AS ok FROM d""")
def split_drift(spark, sf):
    return C.split_drift(_rates(spark, sf)).withColumn("drift", F.round("drift", 9))


@query("dataset_stats", f"WITH {fx.POSTS}, e AS (SELECT unnest(labels) AS label FROM posts) SELECT label, count(*) AS n FROM e GROUP BY 1")
def dataset_stats(spark, sf):
    return C.dataset_stats(fx.posts(spark, sf))


def _lines(spark, sf):
    df = _splits(spark, sf)
    notes = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("note "), F.col("doc_id").cast("string")))
    return df.select(F.when(F.col("doc_id") % 101 != 7, F.col("id")).alias("id"), F.col("doc_id").alias("line"), "labels", "text", notes.alias("notes"), F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("collected_at"), "source")


_LINES = f"""{SPLIT_ROWS}, lines AS (SELECT CASE WHEN doc_id % 101 <> 7 THEN id END AS id, doc_id AS line, labels, text, CASE WHEN doc_id % 3 = 0 THEN 'note ' || CAST(doc_id AS VARCHAR) END AS notes,
  strftime(collected_at, '%Y-%m-%dT%H:%M:%S') AS collected_at, source FROM split_rows)"""
_POPULATED, _LISTS, _TEXTS = ["labels", "text", "notes", "collected_at", "source"], ["labels"], ["notes", "text"]


@query("duplicate_ids", f"WITH {_LINES} SELECT id, count(*) AS n, array_to_string(list(line ORDER BY line), ',') AS lines FROM lines WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return C.duplicate_ids(_lines(spark, sf)).withColumn("lines", F.array_join(F.transform("lines", lambda x: x.cast("string")), ","))


_RICH = """rich AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY (CASE WHEN len(labels) > 0 THEN 1 ELSE 0 END + CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(notes) <> '' THEN 1 ELSE 0 END
  + CASE WHEN trim(collected_at) <> '' THEN 1 ELSE 0 END + CASE WHEN trim(source) <> '' THEN 1 ELSE 0 END) DESC, len(labels) DESC, length(trim(coalesce(notes, ''))) DESC, length(trim(coalesce(text, ''))) DESC, line) AS place FROM lines WHERE id IS NOT NULL)"""


@query("merge_duplicates", f"""WITH {_LINES}, {_RICH}, o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place <> 1, line) AS turn FROM rich),
lab AS (SELECT id, array_to_string(list_sort(list_distinct(flatten(list(labels)))), ',') AS labels FROM o GROUP BY id),
m AS (SELECT id, min(line) AS line, count(*) AS merged, arg_max(notes, (length(trim(coalesce(notes, ''))), -turn)) FILTER (WHERE notes IS NOT NULL) AS notes, md5(arg_max(text, (length(trim(text)), -turn))) AS text_digest, min(collected_at) AS collected_at,
  arg_min(source, turn) FILTER (WHERE trim(source) <> '') AS source FROM o GROUP BY id)
SELECT m.id, line, merged, labels, notes, text_digest, collected_at, source FROM m JOIN lab USING (id)
UNION ALL SELECT id, line, 1, array_to_string(list_sort(labels), ','), notes, md5(text), collected_at, source FROM lines WHERE id IS NULL""")
def merge_duplicates(spark, sf):
    out = C.merge_duplicates(_lines(spark, sf), _POPULATED, _LISTS, _TEXTS, "collected_at", ["source"])
    return out.select("id", "line", "merged", F.concat_ws(",", F.array_sort("labels")).alias("labels"), "notes", F.md5("text").alias("text_digest"), "collected_at", "source")


@query("duplicate_report", f"""WITH {_LINES}, {_RICH} SELECT id, count(*) AS n, min(line) FILTER (WHERE place = 1) AS canonical_line, min(line) AS first_line,
concat_ws(',', CASE WHEN count(DISTINCT array_to_string(labels, ',')) > 1 THEN 'labels' END, CASE WHEN count(DISTINCT coalesce(notes, '~')) > 1 THEN 'notes' END, CASE WHEN count(DISTINCT coalesce(source, '~')) > 1 THEN 'source' END) AS varying FROM rich GROUP BY id HAVING count(*) > 1""")
def duplicate_report(spark, sf):
    return C.duplicate_report(_lines(spark, sf), ["labels", "notes", "source"], _POPULATED, _LISTS, _TEXTS)


@query("assign_null_ids", f"""WITH n AS (SELECT doc_id AS line, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'x_' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents),
k AS (SELECT max(CAST(substr(id, 3) AS BIGINT)) AS largest FROM n WHERE id LIKE 'x_%')
SELECT line, coalesce(id, 'x_auto_' || CASE WHEN k.largest + r < 10000 THEN lpad(CAST(k.largest + r AS VARCHAR), 4, '0') ELSE CAST(k.largest + r AS VARCHAR) END) AS id FROM (SELECT *, row_number() OVER (PARTITION BY id IS NULL ORDER BY line) AS r FROM n), k""")
def assign_null_ids(spark, sf):
    key = F.when(F.col("doc_id") % 9 == 0, None).when(F.col("doc_id") % 4 == 0, F.concat(F.lit("x_"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return C.assign_null_ids(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("line"), key.alias("id")))


@query("class_weights", f"WITH {fx.SCORED} SELECT count(*) / (2 * greatest(1, count(*) - sum(gold_scam))) AS w_clean, count(*) / (2 * greatest(1, sum(gold_scam))) AS w_scam, (count(*) - sum(gold_topic)) / greatest(1, sum(gold_topic)) AS topic_pos_weight FROM scored")
def class_weights(spark, sf):
    return C.class_weights(fx.scored(spark, sf), "gold_scam", "gold_topic")


_DIGEST = "CAST(('0x' || substr(sha256(concat_ws(chr(31), id, text, gold)), 1, 12)) AS BIGINT)"


@query("dataset_fingerprint", f"WITH {fx.SCORED}, d AS (SELECT {fx.split_sql()} AS split, {_DIGEST} AS d FROM scored) SELECT split, count(*) AS n_rows, CAST(CAST(sum(d) AS HUGEINT) AS VARCHAR) AS digest_sum, bit_xor(d) AS digest_xor FROM d GROUP BY 1")
def dataset_fingerprint(spark, sf):
    return C.fingerprint(fx.with_split(fx.scored(spark, sf)), ["id", "text", "gold"], ["split"])


@query("lineage_check", f"WITH {fx.SCORED} SELECT 'holdout' AS split, CAST(count(*) - 1 AS BIGINT) AS stored, count(*) AS actual FROM scored WHERE {fx.split_sql()} = 'holdout'")
def lineage_check(spark, sf):
    actual = C.fingerprint(fx.with_split(fx.scored(spark, sf)), ["id", "text", "gold"], ["split"])
    stored = actual.withColumn("n_rows", F.col("n_rows") - F.when(F.col("split") == "holdout", 1).otherwise(0))
    return C.lineage_check(stored, actual, "split", "n_rows")


@query("split_manifest", f"""WITH {fx.SCORED}, d AS (SELECT {fx.split_sql()} AS split, gold, {_DIGEST} AS d FROM scored) SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE gold = 'scam') AS scam, count(*) FILTER (WHERE gold = 'topic_crypto') AS topic_crypto,
count(*) FILTER (WHERE gold = 'clean') AS clean, bit_xor(d) AS digest_xor FROM d GROUP BY 1""")
def split_manifest(spark, sf):
    rows = fx.with_split(fx.scored(spark, sf))
    support = rows.groupBy("split").agg(*[F.count_if(F.col("gold") == c).alias(c) for c in L.CLASSES])
    return C.fingerprint(rows, ["id", "text", "gold"], ["split"]).drop("digest_sum").join(support, "split")


@query("tagger_rollup", f"WITH {fx.TURNS} SELECT handle AS tagger, count(*) AS callout_count FROM turns GROUP BY 1")
def tagger_rollup(spark, sf):
    return fx.turns(spark, sf).groupBy(F.col("handle").alias("tagger")).agg(F.count("*").alias("callout_count"))


@query("mixing_report", f"""WITH {fx.POSTS}, e AS (SELECT unnest(labels) AS label FROM posts), c AS (SELECT label, count(*) AS n FROM e GROUP BY 1), t AS (SELECT count(*) AS total FROM posts)
SELECT label, n, CASE WHEN n < 2000 THEN 'below floor' WHEN n < 10000 THEN 'below target' ELSE 'ok' END AS status, CASE WHEN n / total >= 0.1e0 THEN 'head' WHEN n / total >= 0.01e0 THEN 'mid' ELSE 'tail' END AS tier FROM c, t""")
def mixing_report(spark, sf):
    return C.mixing_report(fx.posts(spark, sf))


@query("set_ops", f"""WITH {SPLIT_ROWS}, a AS (SELECT DISTINCT id FROM split_rows WHERE split = 'train'), b AS (SELECT DISTINCT id FROM split_rows WHERE split = 'holdout')
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS in_either, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS in_both, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_first""")
def set_ops(spark, sf):
    sides = _splits(spark, sf).where("split in ('train', 'holdout')").groupBy("id").agg(F.max(F.col("split") == "train").alias("a"), F.max(F.col("split") == "holdout").alias("b"))
    return sides.agg(F.count("*").alias("in_either"), F.count_if(F.col("a") & F.col("b")).alias("in_both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_first"))


