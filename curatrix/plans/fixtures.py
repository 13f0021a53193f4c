"""The test tables as posts, scores, threads, events; as DataFrames, and as SQL that begins the queries' oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.labels import collapse_label, constants, multi_labels


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uniform(column: str, salt: str) -> Column:
    """A number in 0..1 from the id and a salt; the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{salt}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967295e0)


def uniform_sql(column: str, salt: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({column} AS VARCHAR) || ':{salt}'), 1, 8))::UBIGINT AS DOUBLE) / 4294967295e0"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, id, text, lang, source, collected_at, labels, toxic, quality)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = F.array_compact(
        F.array(F.when(F.col("toxic") == 1, F.lit("phishing")), F.when(F.col("quality") == 0, F.lit("low_effort")), F.when(F.col("quality").isNotNull() & F.col("source").isin("src3", "src7"), F.lit("topic_crypto")))
    )
    at = F.when(F.col("doc_id") % 17 != 0, F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60))
    return docs.join(labels, "doc_id", "left").select("doc_id", F.col("doc_id").cast("string").alias("id"), "text", "lang", "source", at.alias("collected_at"), found.alias("labels"), "toxic", "quality")


POSTS = """
posts AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, d.text, d.lang, d.source,
         CASE WHEN d.doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS BIGINT)) END AS collected_at,
         list_filter([CASE WHEN l.toxic = 1 THEN 'phishing' END, CASE WHEN l.quality = 0 THEN 'low_effort' END,
                      CASE WHEN l.quality IS NOT NULL AND d.source IN ('src3', 'src7') THEN 'topic_crypto' END], lambda x: x IS NOT NULL) AS labels,
         l.toxic, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), gold AS (
  SELECT *, CASE WHEN toxic = 1 THEN 'scam' WHEN list_contains(labels, 'topic_crypto') THEN 'topic_crypto' ELSE 'clean' END AS gold,
         CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS gold_scam, CASE WHEN list_contains(labels, 'topic_crypto') THEN 1 ELSE 0 END AS gold_topic
  FROM posts
)"""


def scored(spark: SparkSession, sf_dir: str, salt: str = "") -> DataFrame:
    """posts with gold, gold_scam, gold_topic, multi (labels), and probabilities p_scam and p_topic of a made-up model."""
    df = posts(spark, sf_dir)
    df = df.withColumn("gold", collapse_label(F.col("labels"))).withColumn("multi", multi_labels(F.col("labels")))
    df = df.withColumn("gold_scam", F.array_contains("labels", "phishing").cast("int")).withColumn("gold_topic", F.array_contains("labels", "topic_crypto").cast("int"))
    p_scam = F.lit(4e-1) * F.col("gold_scam") + F.lit(6e-1) * uniform("doc_id", "scam" + salt)
    p_topic = F.lit(5e-1) * F.col("gold_topic") + F.lit(5e-1) * uniform("doc_id", "topic" + salt)
    return df.withColumn("p_scam", p_scam).withColumn("p_topic", p_topic).withColumn("p_clean", 1 - F.greatest("p_scam", "p_topic"))


def scored_sql(salt: str = "", name: str = "scored") -> str:
    return f"""{name} AS (
  SELECT *, 1 - greatest(p_scam, p_topic) AS p_clean FROM (
    SELECT *, 4e-1 * gold_scam + 6e-1 * ({uniform_sql("doc_id", "scam" + salt)}) AS p_scam, 5e-1 * gold_topic + 5e-1 * ({uniform_sql("doc_id", "topic" + salt)}) AS p_topic
    FROM gold)
)"""


SCORED = f"{POSTS}, {scored_sql()}"

#: The four parts of the frozen split, by thousandths of a hash.
SPLITS = [("train", 600), ("valid", 700), ("calib", 750), ("holdout", 1000)]


def with_split(df: DataFrame, salt: str = "42") -> DataFrame:
    part = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{salt}"))), 1, 6), 16, 10).cast("long") % 1000
    out = F.lit("holdout")
    for name, upto in reversed(SPLITS[:-1]):
        out = F.when(part < upto, name).otherwise(out)
    return df.withColumn("split", out)


def split_sql(column: str = "doc_id", salt: str = "42") -> str:
    part = f"(CAST(('0x' || substr(md5(CAST({column} AS VARCHAR) || ':{salt}'), 1, 6)) AS BIGINT) % 1000)"
    return f"CASE WHEN {part} < 600 THEN 'train' WHEN {part} < 700 THEN 'valid' WHEN {part} < 750 THEN 'calib' ELSE 'holdout' END"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reply threads: (conv_id, turn, status_id, parent_status_id, handle, role, text)."""
    df = table(spark, sf_dir, "conversations")
    name = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    parent = F.when(F.col("turn") > 0, F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string")))
    role = F.when(F.col("role") == "system", "context").when(F.col("role") == "assistant", "ai_reply").when(F.col("turn") <= 1, "original_post").otherwise("evidence")
    handle = F.concat(F.lit("User"), (F.col("conv_id") % 37).cast("string"), F.substring("role", 1, 1))
    return df.select("conv_id", "turn", name.alias("status_id"), parent.alias("parent_status_id"), handle.alias("handle"), role.alias("role"), "text")


TURNS = """
turns AS (
  SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS status_id,
         CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || '-' || CAST(turn - 1 AS VARCHAR) END AS parent_status_id,
         'User' || CAST(conv_id % 37 AS VARCHAR) || substr(role, 1, 1) AS handle,
         CASE WHEN role = 'system' THEN 'context' WHEN role = 'assistant' THEN 'ai_reply' WHEN turn <= 1 THEN 'original_post' ELSE 'evidence' END AS role, text
  FROM conversations
)"""


def no_labels() -> Column:
    return constants([])
