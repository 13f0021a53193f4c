"""Signals of coordinated campaigns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.plans.ranking import previous_values, running_sums


def bursts(posts: DataFrame, what: str, handle: str, at: str, gap: str = "10 minutes", least: int = 2) -> DataFrame:
    """(what, start, end, n_posts, n_handles) of runs of posts with the same `what` that several accounts take part in.

    A run ends where nothing follows within the gap, wherever that is: no window's edge cuts it. Posts of one `what`, however many, are
    ordered and counted by ranges. Null texts, hosts or times take no part.
    """
    rows = posts.select(F.col(what).alias("what"), F.col(handle).alias("handle"), F.col(at).alias("at")).where("what is not null and at is not null")
    ordered = previous_values(rows, ["what"], ["at", "handle"], ["at"])
    begins = F.col("previous_at").isNull() | (F.col("at") >= F.col("previous_at") + F.expr(f"interval {gap}"))
    runs = running_sums(ordered, ["what"], ["at", "handle"], {"run": begins.cast("long")})
    out = runs.groupBy("what", "run").agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count("*").alias("n_posts"), F.count_distinct("handle").alias("n_handles"))
    return out.where(F.col("n_handles") >= least).select(F.col("what").alias(what), "start", "end", "n_posts", "n_handles")


def coordinated_bursts(posts: DataFrame, text: str, handle: str, at: str, gap: str = "10 minutes", least: int = 2) -> DataFrame:
    """bursts() of equal texts, told by their digest."""
    return bursts(posts.withColumn("digest", F.md5(text)), "digest", handle, at, gap, least)


def link_bursts(posts: DataFrame, urls: str, handle: str, at: str, gap: str = "10 minutes", least: int = 2) -> DataFrame:
    """bursts() of links to the same host; a post counts once for each host."""
    hosts = F.array_distinct(F.array_compact(F.transform(urls, lambda u: F.lower(F.try_parse_url(u, F.lit("HOST"))))))
    return bursts(posts.withColumn("host", F.explode(hosts)), "host", handle, at, gap, least)


def shared_hosts(rows: DataFrame, url: str, account: str, least: int = 2) -> DataFrame:
    """(host, n_accounts, n_urls) of hosts that several accounts share."""
    host = F.lower(F.try_parse_url(F.col(url), F.lit("HOST")))
    out = rows.where(host.isNotNull()).groupBy(host.alias("host")).agg(F.count_distinct(account).alias("n_accounts"), F.count("*").alias("n_urls"))
    return out.where(F.col("n_accounts") >= least)


def follower_ratio(followers: Column, following: Column) -> Column:
    return followers / F.greatest(following, F.lit(1))


def account_age(created: Column, at: Column) -> Column:
    """Whole days from the account's first day on; 0 for one that begins later."""
    return F.greatest(F.date_diff(at, created), F.lit(0))


def risk_fusion(scores: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the scores that are there; null if none is."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for score, w in scores.values():
        total = total + F.coalesce(score * w, F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), w).otherwise(0.0)
    return F.try_divide(total, weight)


def active_learning_queue(rows: DataFrame, score: str, at: float, n: int, key: str) -> DataFrame:
    """The n least certain rows, nearest to the threshold first."""
    return rows.withColumn("distance", F.abs(F.col(score) - at)).orderBy("distance", key).limit(n)
