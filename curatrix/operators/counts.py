"""Counts, drift, integrity and duplicates of labelled tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.labels import CLASSES, feature_tokens
from curatrix.plans.ranking import running_sums


def label_counts(rows: DataFrame, labels: str = "labels", split: str = "split") -> DataFrame:
    return rows.select(split, F.explode(labels).alias("label")).groupBy(split, "label").agg(F.count("*").alias("n"))


def mapping_stats(rows: DataFrame, raw: Column, label: Column, text: Column) -> DataFrame:
    clean = label == "clean"
    return rows.agg(
        F.count_if(F.size(raw) == 0).alias("unlabelled_to_clean"), F.count_if((F.size(raw) > 0) & clean).alias("other_to_clean"),
        F.count_if(F.coalesce(text, F.lit("")) == "").alias("skipped_empty"), F.count("*").alias("n_rows"),
    )


def token_rates(rows: DataFrame, labels: str = "labels", split: str = "split") -> DataFrame:
    """(split, token, n, n_rows, rate) of labels and pairs of labels; split null: all rows. Absent classes have rate 0."""
    spark = rows.sparkSession
    sizes = rows.rollup(split).agg(F.count("*").alias("n_rows"), F.grouping(split).alias("whole"))
    tokens = rows.select(split, F.explode(feature_tokens(F.col(labels))).alias("token"))
    counts = tokens.groupBy(split, "token").agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.groupBy("token").agg(F.sum("n").alias("n")).withColumn(split, F.lit(None).cast("string")))
    seen = both.select("token").unionByName(spark.createDataFrame([(f"L:{c}",) for c in CLASSES], "token string")).distinct()
    cells = sizes.where(f"whole = 1 or {split} is not null").drop("whole").crossJoin(F.broadcast(seen))  # splits by tokens: both few
    named = both.withColumnRenamed(split, "s").withColumnRenamed("token", "t")
    out = cells.join(named, cells[split].eqNullSafe(named.s) & (cells.token == named.t), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(split, "token", "n", "n_rows", (F.col("n") / F.col("n_rows")).alias("rate"))


def split_drift(rates: DataFrame, split: str = "split", label_limit: float = 0.03, pair_limit: float = 0.05) -> DataFrame:
    """(split, kind, drift, ok): the greatest distance of a split's rates from those of all rows."""
    whole = rates.where(F.col(split).isNull()).select(F.col("token").alias("t"), F.col("rate").alias("global_rate"))
    apart = rates.where(F.col(split).isNotNull()).join(whole, F.col("token") == F.col("t"))
    kind = F.when(F.col("token").startswith("L:"), "label").otherwise("pair")
    out = apart.groupBy(split, kind.alias("kind")).agg(F.max(F.abs(F.col("rate") - F.col("global_rate"))).alias("drift"))
    return out.withColumn("ok", F.col("drift") <= F.when(F.col("kind") == "label", label_limit).otherwise(pair_limit))


def dataset_stats(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """(label, n), most frequent first."""
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def duplicate_ids(rows: DataFrame, key: str = "id", line: str = "line") -> DataFrame:
    """(key, n, lines) of keys on more than one line."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("lines")).where("n > 1")


def richness(populated: list[str], lists: list[str], texts: list[str]) -> Column:
    """What makes a row the canonical one: populated fields, then the lists' sizes, then the texts' lengths."""
    def filled(c: str) -> Column:
        kind = F.col(c)
        return F.when(F.size(kind) > 0, 1).otherwise(0) if c in lists else F.when(F.trim(kind) != "", 1).otherwise(0)

    total = reduce(lambda a, b: a + b, [filled(c) for c in populated])
    return F.struct(total.alias("fields"), *[F.greatest(F.size(c), F.lit(0)).alias(f"n_{c}") for c in lists], *[F.length(F.trim(F.coalesce(F.col(c), F.lit("")))).alias(f"len_{c}") for c in texts])


def merge_duplicates(rows: DataFrame, populated: list[str], lists: list[str], texts: list[str], time: str, others: list[str], key: str = "id", line: str = "line") -> DataFrame:
    """One row for each key, from its richest row (ties: the first line) and then the others in order of lines.

    Lists: ordered union. Texts: a strictly longer trimmed value replaces. Time: the earliest. Other fields: the first that is
    there. Rows without a key pass as they are. `merged` counts the rows. Rows of a key are summed up where they are; what meets
    in a task is the distinct elements of a key's lists.
    """
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    present = lambda c: F.when(F.trim(c) != "", c)
    named = rows.where(F.col(key).isNotNull()).withColumn("__rich", richness(populated, lists, texts))
    fold = [F.max_by(F.struct(*lists, *texts, *others), F.struct("__rich", -F.col(line))).alias("__best")]
    fold += [F.max_by(c, F.struct(size(F.col(c)), -F.col(line))).alias(f"__long_{c}") for c in texts]
    fold += [F.min_by(present(F.col(c)), F.when(present(F.col(c)).isNotNull(), F.col(line))).alias(f"__first_{c}") for c in others]
    merged = named.groupBy(key).agg(*fold, F.min(time).alias(time), F.min(line).alias(line), F.count("*").alias("merged"))
    out = {c: F.col(f"__best.{c}") for c in [*lists, *texts, *others]}
    for c in lists:
        # elements by the line and the place that they come first at
        elements = named.select(key, line, F.posexplode(c).alias("__at", "__e")).groupBy(key, "__e").agg(F.min(F.struct(line, "__at")).alias("__first"))
        union = F.transform(F.array_sort(F.collect_list(F.struct("__first", "__e"))), lambda s: s["__e"])
        merged = merged.join(elements.groupBy(key).agg(union.alias(f"__all_{c}")), key, "left")
        none = F.array().cast(rows.schema[c].dataType)
        out[c] = F.array_distinct(F.concat(F.coalesce(out[c], none), F.coalesce(f"__all_{c}", none)))
    for c in texts:
        out[c] = F.when(size(out[c]) == size(F.col(f"__long_{c}")), out[c]).otherwise(F.col(f"__long_{c}"))
    for c in others:
        out[c] = F.coalesce(present(out[c]), F.col(f"__first_{c}"))
    names = [key, line, *lists, *texts, time, *others]
    nameless = rows.where(F.col(key).isNull()).select(*names).withColumn("merged", F.lit(1).cast("long"))
    return merged.select(*[out.get(c, F.col(c)).alias(c) for c in names], "merged").unionByName(nameless)


def duplicate_report(rows: DataFrame, fields: list[str], populated: list[str], lists: list[str], texts: list[str], key: str = "id", line: str = "line") -> DataFrame:
    """(key, n, canonical_line, first_line, varying): which fields differ among the rows of a key."""
    rich = rows.where(F.col(key).isNotNull()).withColumn("__rich", richness(populated, lists, texts))
    varying = F.concat_ws(",", *[F.when(F.count_distinct(F.to_json(F.struct(c))) > 1, F.lit(c)) for c in fields])
    out = rich.groupBy(key).agg(F.count("*").alias("n"), F.max_by(line, F.struct("__rich", -F.col(line))).alias("canonical_line"), F.min(line).alias("first_line"), varying.alias("varying"))
    return out.where("n > 1")


def assign_null_ids(rows: DataFrame, key: str = "id", line: str = "line", prefix: str = "x_auto_") -> DataFrame:
    """Rows without a key get prefix + number, in order of lines, after the largest number of keys x_<n>."""
    number = F.max(F.when(F.col(key).rlike(r"^x_(auto_)?\d+$"), F.regexp_extract(key, r"(\d+)$", 1).cast("long"))).alias("largest")
    largest = F.broadcast(rows.agg(number))  # one row
    without = rows.where(F.col(key).isNull())
    nameless = running_sums(without, [], [line], {"place": F.lit(1)})
    digits = (F.coalesce("largest", F.lit(0)) + F.col("place")).cast("string")
    padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)  # lpad alone cuts longer ones
    given = nameless.crossJoin(largest).withColumn(key, F.concat(F.lit(prefix), padded))
    return rows.where(F.col(key).isNotNull()).unionByName(given.select(*rows.columns))


def class_weights(rows: DataFrame, y_scam: str, y_topic: str) -> DataFrame:
    """Cross-entropy weights total / (2 * n) of the scam classes, and the topic's negatives over positives."""
    total, scam, topic = F.count("*"), F.sum(y_scam), F.sum(y_topic)
    one = lambda c: F.greatest(F.lit(1), c)
    return rows.agg((total / (2 * one(total - scam))).alias("w_clean"), (total / (2 * one(scam))).alias("w_scam"), ((total - topic) / one(topic)).alias("topic_pos_weight"))


def fingerprint(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(n_rows, digest_sum, digest_xor) of rows in whatever order: row digests added up and xored."""
    cell = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    digest = F.conv(F.substring(F.sha2(cell, 256), 1, 12), 16, 10).cast("long")
    out = rows.withColumn("__d", digest).groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), F.sum(F.col("__d").cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor("__d").alias("digest_xor"))
    return out


def lineage_check(stored: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, stored, actual) where a stored value is not the recomputed one."""
    a, b = stored.select(key, F.col(value).alias("stored")), actual.select(key, F.col(value).alias("actual"))
    return a.join(b, key, "full_outer").where(~F.col("stored").eqNullSafe(F.col("actual")))


def mixing_report(rows: DataFrame, labels: str = "labels", floor: int = 2000, target: int = 10_000) -> DataFrame:
    """(label, n, status, tier): label counts against floor and target; head, mid or tail by share of rows with the label."""
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    counts = rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).crossJoin(total)
    status = F.when(F.col("n") < floor, "below floor").when(F.col("n") < target, "below target").otherwise("ok")
    share = F.col("n") / F.col("total")
    return counts.select("label", "n", status.alias("status"), F.when(share >= 0.1, "head").when(share >= 0.01, "mid").otherwise("tail").alias("tier"))
