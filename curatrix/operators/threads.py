"""Reply threads: conversion of callouts, unions, parent checks, flagged accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles of posts in a thread.
ROLES = ["original_post", "ai_reply", "evidence", "other_reply", "context"]
_POST = "struct<status_id:string,handle:string,role:string,parent_status_id:string,text:string>"


def flatten_callouts(payload: DataFrame) -> DataFrame:
    """Callout payloads (callout, reply, original structs of status_id, handle, text) as columns with defaults."""
    def part(name: str) -> list[Column]:
        return [F.col(f"{name}.status_id").alias(f"{name}_id"), F.coalesce(F.lower(f"{name}.handle"), F.lit("")).alias(f"{name}_handle"), F.coalesce(f"{name}.text", F.lit("")).alias(f"{name}_text")]

    return payload.select(*part("callout"), *part("reply"), *part("original"))


def fetch_coverage(payload: DataFrame, by: str) -> DataFrame:
    return payload.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("reply.status_id").isNotNull()).alias("with_reply"), F.count_if(F.col("original.status_id").isNotNull()).alias("with_original"))


def convert_callouts(flat: DataFrame) -> DataFrame:
    """(id, labels, posts, reply_id): a thread for each callout whose reply has text and an id."""
    post = lambda name, role, parent: F.struct(F.col(f"{name}_id").alias("status_id"), F.col(f"{name}_handle").alias("handle"), F.lit(role).alias("role"), parent.alias("parent_status_id"), F.col(f"{name}_text").alias("text"))
    none = F.lit(None).cast("string")
    posts = F.array_compact(F.array(F.when(F.col("original_text") != "", post("original", "original_post", none)), post("reply", "ai_reply", F.col("original_id")), F.when(F.col("callout_text") != "", post("callout", "evidence", F.col("reply_id")))))
    rows = flat.where("reply_text <> '' and reply_id is not null")
    return rows.select(F.concat(F.lit("sample-"), "reply_id").alias("id"), F.array(F.lit("ai_generated_reply")).alias("labels"), posts.alias("posts"), "reply_id")


def unify_threads(existing: DataFrame, sources: list[DataFrame], order: str = "reply_id") -> DataFrame:
    """(id, posts, origin): existing threads, and converted ones whose reply none of them nor an earlier source has."""
    known = existing.select(F.explode("posts").alias("p")).where("p.role = 'ai_reply'").select(F.col("p.status_id").alias("known")).distinct()
    parts = [s.select("id", "posts", "reply_id", F.lit(k + 1).alias("origin"), F.col(order).alias("__order")) for k, s in enumerate(sources)]
    new = parts[0]
    for p in parts[1:]:
        new = new.unionByName(p)
    new = new.join(known, new.reply_id == known.known, "left_anti")
    first = F.row_number().over(Window.partitionBy("reply_id").orderBy("origin", "__order"))
    new = new.withColumn("place", first).where("place = 1").select("id", "posts", "origin")
    return existing.select("id", "posts", F.lit(0).alias("origin")).unionByName(new)


def as_threads(turns: DataFrame, key: str) -> DataFrame:
    """(key, posts) of a table of posts; a thread's posts stay together in their order."""
    post = F.struct("turn", "status_id", "handle", "role", "parent_status_id", "text")
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(post)).alias("posts"))


def parent_check(threads: DataFrame, key: str) -> DataFrame:
    """(key, unknown_parents): parents that are no post of the thread; looked up inside the row."""
    ids = F.transform("posts", lambda p: p["status_id"])
    unknown = F.filter("posts", lambda p: p["parent_status_id"].isNotNull() & ~F.array_contains(ids, p["parent_status_id"]))
    return threads.select(key, F.transform(unknown, lambda p: p["parent_status_id"]).alias("unknown_parents")).where(F.size("unknown_parents") > 0)


def reply_context(turns: DataFrame) -> DataFrame:
    """(status_id, parent_id, parent_text) of replies whose parent is there."""
    parents = turns.select(F.col("status_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return turns.join(parents, turns.parent_status_id == parents.parent_id).select("status_id", "parent_id", "parent_text")


def flagged_accounts(posts: DataFrame, source: str, confidence: Column) -> DataFrame:
    """(handle, n, sources, confidence) of authors of ai replies."""
    found = posts.where("role = 'ai_reply'").groupBy(F.lower("handle").alias("handle"))
    return found.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(source)).alias("sources")).withColumn("confidence", F.when(confidence, "high").otherwise("medium"))


def new_flagged(flagged: DataFrame, listed: DataFrame) -> DataFrame:
    known = listed.select(F.lower("handle").alias("known")).distinct()
    return flagged.select(F.lower("handle").alias("handle")).distinct().join(known, F.col("handle") == F.col("known"), "left_anti")


def truth_over_inferred(truth: DataFrame, inferred: DataFrame, key: str = "reply_id") -> DataFrame:
    """(key, origin): truth rows, and inferred ones that truth lacks."""
    rest = inferred.join(truth.select(key), key, "left_anti")
    return truth.select(key, F.lit("truth").alias("origin")).unionByName(rest.select(key, F.lit("inferred").alias("origin")))
