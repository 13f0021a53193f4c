"""Joins between splits, pools, change lists, predictions, threads and manifests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.labels import normalize_change_labels


def split_leakage(rows: DataFrame, splits: list[str], key: str = "id", split: str = "split") -> DataFrame:
    """(a, b, shared): how many ids each pair of splits shares. One shuffle by id, whatever the number of pairs."""
    spark = rows.sparkSession
    held = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    found = held.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    all_pairs = spark.createDataFrame([tuple(sorted(p)) for p in combinations(splits, 2)], "a string, b string")
    return all_pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def forbidden_overlap(holdout: DataFrame, earlier: DataFrame, key: str = "id", source: str = "source") -> DataFrame:
    """(source, n_rows, overlap): of each source's holdout rows, those whose id is in an earlier split."""
    used = earlier.select(F.col(key).alias("used")).distinct()
    return holdout.join(used, holdout[key] == used.used, "left").groupBy(source).agg(F.count("*").alias("n_rows"), F.count("used").alias("overlap"))


def calib_pool_candidates(pool: DataFrame, base: DataFrame, holdout: DataFrame, text: str = "text") -> DataFrame:
    """Pool rows whose exact text is in neither base nor holdout."""
    taken = base.select(text).unionByName(holdout.select(text)).select(F.xxhash64(text).alias("taken_hash"), F.col(text).alias("taken")).distinct()
    return pool.join(taken, (F.xxhash64(pool[text]) == taken.taken_hash) & (pool[text] == taken.taken), "left_anti")


def apply_relabels(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """rows with the labels of changes (id, new_labels) where it has some; `changed` only where the labels really differ."""
    new = changes.select(F.col(key).alias("change_id"), normalize_change_labels(F.col("new_labels")).alias("new_labels")).where(F.size("new_labels") > 0)
    out = rows.join(new, rows[key] == new.change_id, "left")
    changed = F.col("new_labels").isNotNull() & ~F.col("labels").eqNullSafe(F.col("new_labels"))
    return out.withColumn("changed", changed).withColumn("labels", F.coalesce("new_labels", "labels")).drop("change_id", "new_labels")


def relabels_not_found(rows: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    return changes.join(rows.select(key), key, "left_anti")


def align_predictions(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    return gold.join(predictions, key)


def cache_coverage(prepared: DataFrame, cached: DataFrame, key: str = "id") -> DataFrame:
    """(missing, first_missing): prepared rows without a cached one."""
    return prepared.join(cached.select(key), key, "left_anti").agg(F.count("*").alias("missing"), F.min(key).alias("first_missing"))


def flag_seen(rows: DataFrame, train: DataFrame, handle: str) -> DataFrame:
    """Appends `seen`: whether the handle is among those of train."""
    known = train.select(F.col(handle).alias("known")).where("known is not null").distinct()
    return rows.join(known, rows[handle] == known.known, "left").withColumn("seen", F.col("known").isNotNull()).drop("known")


def pending(callouts: DataFrame, fetched: DataFrame, key: str, ignore_case: bool = False) -> DataFrame:
    """Callouts that have not been fetched."""
    form = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    done = fetched.select(form(F.col(key)).alias("done")).distinct()
    return callouts.join(done, form(callouts[key]) == done.done, "left_anti")


def reconcile(index: DataFrame, actual: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, status): missing where only the index has it, extra where only the data have, else the first difference or ok."""
    a, b = index.select(F.col(key).alias("a"), *[F.col(c).alias(f"a_{c}") for c in compared]), actual.select(F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in compared])
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra")
    for c in compared:
        status = status.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c} differs")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), status.otherwise("ok").alias("status"))
