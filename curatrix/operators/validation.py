"""Validation rules: a row of findings for each rule that a record breaks; one pass, and a count for repeated keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.labels import constants
from curatrix.operators.threads import ROLES

# Categories and priorities of accounts, platforms of posts.
CATEGORIES = ["clean", "crypto", "scam_hub", "scam_reply", "bot", "researcher", "media", "influencer"]
PRIORITIES = ["high", "medium", "low"]
PLATFORMS = ["x", "discord", "web", "dm", "other"]
# Forms of ids.
POST_ID = r"^\d{16,20}$|^x_\d+(_dup\d+)?$|^x_auto_\d+$"
_NUMERIC = r"^\d{16,20}$"


def findings(rows: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, severity, rule) for each rule (severity, name, condition) that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rule"))) for s, n, c in rules]))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*")


def with_repeated(rows: DataFrame, key: str) -> DataFrame:
    """Appends `repeated`: whether other rows have the key too. Keys are counted where they are; rows without one don't move."""
    again = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__again")).agg(F.count("*").alias("__n")).where("__n > 1").select("__again")
    there = rows.where(F.col(key).isNotNull()).join(again, F.col(key) == F.col("__again"), "left")
    nameless = rows.where(F.col(key).isNull()).withColumn("repeated", F.lit(False))
    return there.withColumn("repeated", F.col("__again").isNotNull()).drop("__again").unionByName(nameless)


def post_rules(taxonomy: list[str]) -> list[tuple[str, str, Column]]:
    """On columns id, text, labels, source_id and repeated."""
    labels, id_, source = F.col("labels"), F.col("id"), F.col("source_id")
    return [
        ("error", "labels missing", F.coalesce(F.size(labels), F.lit(0)) <= 0),
        ("error", "text missing", F.col("text").isNull()),
        ("error", "duplicate labels", F.size(F.array_distinct(labels)) < F.size(labels)),
        ("error", "unknown label", F.size(F.array_except(labels, constants(taxonomy))) > 0),
        ("error", "source_id is not id", source.rlike(_NUMERIC) & (source != id_)),
        ("error", "id is not source_id", id_.rlike(_NUMERIC) & source.isNotNull() & ~source.rlike(_NUMERIC)),
        ("error", "duplicate id", F.col("repeated")),
        ("warning", "no id", id_.isNull()),
        ("warning", "empty text", F.trim("text") == ""),
        ("warning", "form of id", ~id_.rlike(POST_ID)),
    ]


def validate_posts(rows: DataFrame, taxonomy: list[str], line: str = "line") -> DataFrame:
    return findings(with_repeated(rows, "id"), line, post_rules(taxonomy))


def json_types(lines: DataFrame, value: str, line: str) -> DataFrame:
    """Findings on the types of a JSON line, before columns are made of it: numbers for ids, strings for lists."""
    v = F.try_parse_json(value)
    form = F.schema_of_variant(v)
    blank = F.trim(value) == ""
    parsed = lines.select(line, blank.alias("blank"), v.isNull().alias("broken"), form.alias("form"))
    return findings(parsed, line, [
        ("warning", "blank line", F.col("blank")), ("error", "broken JSON", F.col("broken") & ~F.col("blank")),
        ("error", "id is not a string", F.col("form").rlike(r"\bid: (?!STRING)")), ("error", "labels is not a list", F.col("form").rlike(r"\blabels: (?!ARRAY)")),
    ])


def validate_threads(threads: DataFrame, key: str) -> DataFrame:
    """On (key, posts)."""
    posts = F.col("posts")
    ids = F.transform(posts, lambda p: p["status_id"])
    any_ = lambda rule: F.exists(posts, rule)
    return findings(threads.withColumn("ids", ids), key, [
        ("error", "no posts", F.coalesce(F.size(posts), F.lit(0)) <= 0),
        ("error", "no ai reply", ~any_(lambda p: p["role"] == "ai_reply")),
        ("error", "unknown role", any_(lambda p: ~p["role"].isin(ROLES))),
        ("error", "handle with @", any_(lambda p: p["handle"].startswith("@"))),
        ("error", "empty status id", any_(lambda p: F.coalesce(F.trim(p["status_id"]), F.lit("")) == "")),
        ("error", "its own parent", any_(lambda p: p["parent_status_id"] == p["status_id"])),
        ("error", "unknown parent", any_(lambda p: p["parent_status_id"].isNotNull() & ~F.array_contains(F.col("ids"), p["parent_status_id"]))),
        ("error", "duplicate status id", F.size(F.array_distinct("ids")) < F.size("ids")),
        ("warning", "empty text", any_(lambda p: F.trim(p["text"]) == "")),
        ("warning", "form of status id", any_(lambda p: ~p["status_id"].rlike(_NUMERIC))),
    ])


def validate_accounts(accounts: DataFrame, line: str) -> DataFrame:
    """On (line, handle, category, followers, priority): the second and later rows of a handle are duplicates."""
    named = accounts.where(F.col("handle").isNotNull())
    first = named.groupBy(F.lower("handle").alias("__key")).agg(F.min(line).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    rows = accounts.join(first, F.lower("handle") == F.col("__key"), "left").withColumn("again", F.col(line) > F.col("__first"))
    return findings(rows, line, [
        ("error", "no handle", F.coalesce(F.trim("handle"), F.lit("")) == ""), ("error", "handle with @", F.col("handle").startswith("@")),
        ("error", "unknown category", ~F.coalesce(F.col("category"), F.lit("")).isin(CATEGORIES)), ("error", "negative followers", F.col("followers") < 0),
        ("error", "unknown priority", ~F.col("priority").isin(PRIORITIES)), ("error", "duplicate handle", F.col("again")),
    ])


def validate_schema(rows: DataFrame, taxonomy: list[str], by: str) -> DataFrame:
    """(by, valid, errors): rows that keep the schema of labelled samples, and those that don't."""
    labels = F.col("labels")
    ok = (
        (F.length("id") > 0) & F.col("text").isNotNull() & (F.size(labels) > 0) & (F.size(F.array_distinct(labels)) == F.size(labels))
        & (F.size(F.array_except(labels, constants(taxonomy))) == 0) & F.col("platform").isin(PLATFORMS)
    )
    return rows.groupBy(by).agg(F.count_if(ok).alias("valid"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("errors"))


def validate_run_index(index: DataFrame, manifests: DataFrame, run_count: int) -> DataFrame:
    """(run_id, rule) of an index (run_id, file_count, total_bytes; counts may be null) against manifests of the same columns, and of the
    number of runs that the index claims: that finding has no run_id. Repeated runs of the index are a finding each; a null run_id is one of no name."""
    said = manifests.groupBy(F.col("run_id").alias("r")).agg(F.max("file_count").alias("c"), F.max("total_bytes").alias("b"))
    both = with_repeated(index.select("run_id", "file_count", "total_bytes", F.lit(True).alias("listed")), "run_id").join(said, F.col("run_id") == F.col("r"), "full_outer")
    listed, there = F.coalesce("listed", F.lit(False)), F.col("r").isNotNull()
    rows = both.withColumn("run_id", F.coalesce("run_id", "r"))
    found = findings(rows, "run_id", [
        ("error", "without a name", listed & F.col("run_id").isNull()), ("error", "no such run", listed & F.col("run_id").isNotNull() & ~there), ("error", "not in the index", ~listed & there),
        ("error", "index file count", there & (F.col("file_count") != F.col("c"))), ("error", "index total bytes", there & (F.col("total_bytes") != F.col("b"))),
        ("error", "listed twice", F.col("repeated")),
    ]).drop("severity")
    number = index.agg(F.count("*").alias("n")).where(F.col("n") != run_count).select(F.lit(None).cast(index.schema["run_id"].dataType).alias("run_id"), F.lit("run count").alias("rule"))
    return found.unionByName(number)


def validate_manifests(files: DataFrame, stated: DataFrame) -> DataFrame:
    """(run_id, rule) of manifests (run_id, file_count, total_bytes) against their files (run_id, size_bytes, sha256)."""
    actual = files.groupBy(F.col("run_id").alias("r")).agg(F.count("*").alias("c"), F.sum("size_bytes").alias("b"), F.count_if(~F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("bad"))
    joined = with_repeated(stated, "run_id").join(actual, F.col("run_id") == F.col("r"), "left")
    return findings(joined, "run_id", [
        ("error", "file count", ~F.col("file_count").eqNullSafe(F.col("c"))), ("error", "total bytes", ~F.col("total_bytes").eqNullSafe(F.col("b"))),
        ("error", "form of digest", F.col("bad") > 0), ("error", "duplicate run", F.col("repeated")),
    ]).drop("severity")
