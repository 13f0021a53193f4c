"""Series of snapshots: versions of edited posts, and how metrics change from one to the next."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.plans.ranking import previous_values
from curatrix.sources.files import staged


def edit_chains(posts: DataFrame, key: str = "id", history: str = "history") -> DataFrame:
    """(id, root, version) of all ids in the posts' edit histories, lists of ids from the oldest on.

    A history may tell a part of the chain only: each id's predecessor is what any history has just before it (the smallest, if
    they differ). Pointers to predecessors are doubled, round by round, until all reach a root: rounds grow with the logarithm
    of the longest chain, and each moves those that have not arrived. version is 1 for the root. Ids that run in a circle have neither.
    """
    ids = posts.select(F.concat(F.coalesce(history, F.array().cast("array<string>")), F.array(key)).alias("h")).select(F.array_distinct(F.array_compact("h")).alias("h"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.struct(F.get("h", i).alias("id"), F.when(i > 0, F.get("h", i - 1)).alias("before")))
    before = ids.where(F.size("h") > 0).select(F.explode(pairs).alias("p")).groupBy("p.id").agg(F.min("p.before").alias("before"))
    up = staged(before.select("id", F.coalesce("before", "id").alias("root"), F.col("before").isNotNull().cast("long").alias("steps"), F.col("before").isNull().alias("done")), "edits")
    # ids that have reached a root stay where they are; only the others are moved and written again
    arrived, left = [up.where("done")], up.where("not done")
    for _ in range(1 + math.ceil(math.log2(max(2, up.count())))):
        whole = reduce(DataFrame.unionByName, [*arrived, left])
        far = whole.select(F.col("id").alias("root"), F.col("root").alias("far"), F.col("steps").alias("more"), F.col("done").alias("there"))
        new = staged(left.select("id", "root", "steps").join(far, "root").select("id", F.col("far").alias("root"), (F.col("steps") + F.col("more")).alias("steps"), F.col("there").alias("done")), "edits")
        arrived.append(new.where("done"))
        left = new.where("not done")
        if left.isEmpty():
            break
    known = reduce(DataFrame.unionByName, arrived).select("id", "root", (F.col("steps") + 1).cast("int").alias("version"))
    return known.unionByName(left.select("id", F.lit(None).cast(up.schema["root"].dataType).alias("root"), F.lit(None).cast("int").alias("version")))


def metric_changes(series: DataFrame, by: str, order: list[str], metrics: list[str]) -> DataFrame:
    """Appends change_<metric>: what a metric has gained since the row before, by the order, of the same post; null on the first."""
    out = previous_values(series, [by], order, metrics)
    return out.select(*series.columns, *[(F.col(m) - F.col(f"previous_{m}")).alias(f"change_{m}") for m in metrics])
