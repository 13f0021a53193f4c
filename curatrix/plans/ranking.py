"""Ranks and running sums over a whole table without a task that sees all of it.

Rows are dealt into ranges of the order; sums by range give each range's offset; ranks and running sums inside a range are
added to it. Ranges are drawn from the rows themselves, so scores, times or ids that crowd together are split as well as
others: only rows that are equal in the whole order share a range by force. The table of ranges has a row for each
partition and one for each key more, and only it is windowed by keys alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.sources.files import staged


def hash_key(value: Column, seed: str | int) -> Column:
    """A repeatable random order: md5 of the value and a seed."""
    return F.md5(F.concat(value.cast("string"), F.lit(f":{seed}")))


def hash_bucket(key: Column) -> Column:
    """The first three digits of a hash_key: it ascends with the key, so ranking by both is ranking by the key."""
    return F.substring(key, 1, 3)


def running_sums(df: DataFrame, keys: list[str], order: list, values: dict[str, Column]) -> DataFrame:
    """Appends, for each name in values, the sum of its column up to and with the row, in the order. Null keys are keys of their own."""
    names = df.columns
    valued = df.withColumns({f"__v_{n}": c for n, c in values.items()})
    # ranges come from a sample, so that a second run may cut elsewhere: written once, they hold
    df = staged(valued.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = df.groupBy(*keys, "__range").agg(*[F.sum(f"__v_{n}").alias(f"__o_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"), *[F.coalesce(F.sum(f"__o_{n}").over(before), F.lit(0)).alias(f"__p_{n}") for n in values])
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"__r_{n}": F.sum(f"__v_{n}").over(inside) for n in values})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__range") == F.col("__r"))
    # no hint: Spark broadcasts the offsets if they are measured to be small
    return df.join(offsets, same).select(*names, *[(F.col(f"__r_{n}") + F.col(f"__p_{n}")).alias(n) for n in values])


def ranked(df: DataFrame, *order: Column | list, name: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """Appends the 0-based rank in the whole order (by keys): columns or lists of them, one after the other."""
    columns = [c for part in order for c in (part if isinstance(part, list) else [part])]
    return running_sums(df, keys or [], columns, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def previous_values(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Appends, for each name in values, `previous_<name>` of the row before in the order, by keys; null on a key's first row.

    A key of any size is cut into ranges. A boundary between ranges cuts one key at most, so there are no more rows to carry over than ranges.
    """
    names = df.columns
    ranges = staged(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    held = F.struct(*values)
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    ends = ranges.groupBy(*keys, "__range").agg(F.max_by(held, F.struct(*order)).alias("__last"))
    carried = ends.withColumn("__carried", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__range"))).where("__carried is not null")
    carried = carried.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__range").alias("__r"), "__carried")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__range") == F.col("__r"))
    rows = ranges.withColumn("__before", F.lag(held).over(inside)).join(F.broadcast(carried), same, "left")
    before = F.coalesce("__before", "__carried")
    return rows.select(*names, *[before[v].alias(f"previous_{v}") for v in values])
