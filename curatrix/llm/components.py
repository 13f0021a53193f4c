"""Connected components of a link table, by label propagation with pointer jumping over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import discard, staged


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, comp): the smallest node that each node of a link reaches. Rounds grow with the logarithm of a path's length.

    Null ends are ignored; a link from a node to itself makes the node its own component. No links: no rows.
    """
    ends = links.select(F.col(u).alias("a"), F.col(v).alias("b")).dropna()
    both = staged(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("comp")), "cc-labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        new = staged(lower.join(jump, "mid", "left").select("node", "was", F.least("mid", F.coalesce("far", "mid")).alias("comp")), "cc-labels")
        discard(labels)
        labels = new.select("node", "comp")
        if new.where("comp <> was").isEmpty():
            discard(both)
            return labels
