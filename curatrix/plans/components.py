"""Connected components of a table of links, by label propagation over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.sources.files import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each node of a link reaches. Links with a null end count for nothing.

    In a round each node takes the smallest label among its neighbours', then its label's label (pointer jumping), so that
    rounds grow with the logarithm of the longest path. Each round is a written table: a lost executor costs its tasks.
    """
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    both = staged(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = staged(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("y"), F.col("root").alias("label")), "y").groupBy("x").agg(F.min("label").alias("label"))
        moved = labels.join(around, F.col("node") == F.col("x")).select("node", F.col("root").alias("before"), F.least("root", "label").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        after = staged(moved.join(jump, "via", "left").select("node", "before", F.least("via", "far").alias("root")), "labels")
        labels = after.select("node", "root")
        if after.where("root <> before").isEmpty():
            return labels
