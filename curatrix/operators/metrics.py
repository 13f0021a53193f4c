"""Classification, calibration and agreement metrics. One pass for each table of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.labels import CLASSES
from curatrix.functions.scores import safe_div
from curatrix.plans.ranking import running_sums

#: Edges of the calibration bins: multiples of the float 0.1, not decimal tenths.
EDGES = [i * 0.1 for i in range(11)]
#: Temperatures that are tried, added up step by step.
TEMPERATURES = [round(0.5 + 0.05 * i, 10) for i in range(91)]


def rates(df: DataFrame) -> DataFrame:
    """Appends precision, recall, f1, fpr and fnr to tp, fp, fn, support and n."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({
        "precision": safe_div(tp, tp + fp), "recall": safe_div(tp, tp + fn), "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "fpr": safe_div(fp, F.col("n") - F.col("support")), "fnr": safe_div(fn, F.col("support")),
    })


def class_counts(rows: DataFrame, gold: dict[str, Column], pred: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(by, label, tp, fp, fn, support, n): one aggregation over all classes, then a row for each."""
    by = by or []
    count = lambda c: F.count_if(c)
    sums = [F.struct(F.lit(c).alias("label"), count(gold[c] & pred[c]).alias("tp"), count(~gold[c] & pred[c]).alias("fp"), count(gold[c] & ~pred[c]).alias("fn"), count(gold[c]).alias("support"), F.count("*").alias("n")) for c in CLASSES]
    return rows.groupBy(*by).agg(F.array(*sums).alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")


def multilabel_metrics(rows: DataFrame, gold: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Metrics of each class of label arrays."""
    has = lambda c: {k: F.array_contains(c, k) for k in CLASSES}
    return rates(class_counts(rows, has(gold), has(pred), by))


def single_label_metrics(rows: DataFrame, gold: str, pred: str, by: list[str] | None = None) -> DataFrame:
    is_ = lambda c: {k: F.col(c) == k for k in CLASSES}
    return rates(class_counts(rows, is_(gold), is_(pred), by))


def summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(micro_f1, macro_f1, micro_precision, micro_recall) of class metrics."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return metrics.groupBy(*(by or [])).agg(safe_div(tp, tp + fp).alias("micro_precision"), safe_div(tp, tp + fn).alias("micro_recall"), safe_div(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), F.avg("f1").alias("macro_f1"))


def exact_match(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.agg(F.avg((F.array_sort(gold) == F.array_sort(pred)).cast("double")).alias("exact_match"), F.count("*").alias("n"))


def confusion_matrix(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """(actual, one count for each predicted class), zeros filled in."""
    spark = rows.sparkSession
    actual = spark.createDataFrame([(c,) for c in CLASSES], "actual string")
    counts = rows.groupBy(F.col(gold).alias("actual")).agg(*[F.count_if(F.col(pred) == c).alias(c) for c in CLASSES])
    return actual.join(counts, "actual", "left").na.fill(0)


def binary_metrics(rows: DataFrame, positive: Column, score: Column, at: float) -> DataFrame:
    hit = score >= at
    return rows.agg(F.count_if(positive & hit).alias("tp"), F.count_if(~positive & hit).alias("fp"), F.count_if(positive & ~hit).alias("fn"), F.count_if(~positive & ~hit).alias("tn"))


def subgroup_metrics(rows: DataFrame, subgroups: str, names: list[str], gold: str, pred: str) -> DataFrame:
    """Class metrics of each subgroup; a subgroup without rows has n = 0 and null metrics."""
    spark = rows.sparkSession
    found = single_label_metrics(rows.withColumn("subgroup", F.explode(subgroups)), gold, pred, ["subgroup"])
    wanted = spark.createDataFrame([(s, c) for s in names for c in CLASSES], "subgroup string, label string")
    return wanted.join(found, ["subgroup", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def score_steps(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """(keys, score, tp, k): of the rows at or above each score, the positives and all. Ranges of scores keep it distributed."""
    steps = rows.groupBy(*keys, score).agg(F.sum(positive.cast("long")).alias("pos"), F.count("*").alias("all"))
    return running_sums(steps, keys, [F.desc(score)], {"tp": F.col("pos"), "k": F.col("all")})


def pr_auc(rows: DataFrame, score: str, positive: Column, start_precision: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """Trapezoids over recall, one point for each score; the first one starts from start_precision at recall 0. No positives: 0."""
    keys = keys or []
    steps = score_steps(rows, keys, score, positive)
    total = rows.groupBy(*keys).agg(F.sum(positive.cast("long")).alias("total"))
    joined = steps.join(F.broadcast(total), keys) if keys else steps.crossJoin(F.broadcast(total))  # a row for each key
    # the point before has all that this score does not add
    tp, k, total = F.col("tp"), F.col("k"), F.col("total")
    last_tp, last_k = tp - F.col("pos"), k - F.col("all")
    last_p = F.when(last_k > 0, safe_div(last_tp, last_k)).otherwise(F.lit(start_precision))
    area = joined.withColumn("area", (safe_div(tp, total) - safe_div(last_tp, total)) * (safe_div(tp, k) + last_p) / 2)
    return area.groupBy(*keys).agg(F.sum("area").alias("pr_auc"))


def calibration_bins(rows: DataFrame, p: str, positive: Column) -> DataFrame:
    """(bin, n, mean_conf, empirical_acc) of ten bins, closed on the left, the last one on both sides; empty ones are 0."""
    spark = rows.sparkSession
    number = F.lit(9)
    for k in range(9, 0, -1):
        number = F.when(F.col(p) < EDGES[k], k - 1).otherwise(number)
    found = rows.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_conf"), F.avg(positive.cast("double")).alias("empirical_acc"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").na.fill(0)


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_conf") - F.col("empirical_acc"))) / F.sum("n")).alias("ece"))


def brier(rows: DataFrame, p: str, positive: Column) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col(p) - positive.cast("double"), 2)).alias("brier"))


def log_loss(p: Column, positive: Column) -> Column:
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    return -F.when(positive, F.ln(q)).otherwise(F.ln(1 - q))


def nll(rows: DataFrame, p: str, positive: Column) -> DataFrame:
    return rows.agg(F.avg(log_loss(F.col(p), positive)).alias("nll"))


def tempered(logit: Column, temperature: Column) -> Column:
    return 1 / (1 + F.exp(-logit / temperature))


def temperature_scaling(rows: DataFrame, logit: str, positive: Column) -> DataFrame:
    """(temperature, nll): the first of TEMPERATURES with the least loss; all are tried in one pass."""
    losses = rows.agg(*[F.avg(log_loss(tempered(F.col(logit), F.lit(t)), positive)).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)])
    tried = losses.select(F.explode(F.array(*[F.struct(F.col(f"t{k}").alias("nll"), F.lit(t).alias("temperature")) for k, t in enumerate(TEMPERATURES)])).alias("s")).select("s.*")
    return tried.agg(F.min(F.struct("nll", "temperature")).alias("s")).select("s.temperature", "s.nll")


def ensemble_mean(predictions: DataFrame, key: str, values: str, seeds: int) -> DataFrame:
    """(key, mean array) of rows that all seeds have."""
    parts = predictions.select(key, F.posexplode(values).alias("pos", "v"))
    means = parts.groupBy(key, "pos").agg(F.avg("v").alias("v"), F.count("*").alias("c")).where(F.col("c") == seeds)
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(values))


def model_parity(a: DataFrame, b: DataFrame, key: str, least_rows: int = 1000) -> DataFrame:
    """(n, mean_delta, agreement, ok) of two scorers' p_scam, p_topic and label on the same rows."""
    other = b.select(F.col(key).alias("k"), F.col("p_scam").alias("s"), F.col("p_topic").alias("t"), F.col("label").alias("l"))
    delta = (F.abs(F.col("p_scam") - F.col("s")) + F.abs(F.col("p_topic") - F.col("t"))) / 2
    out = a.join(other, a[key] == other.k).agg(F.count("*").alias("n"), F.avg(delta).alias("mean_delta"), F.avg((F.col("label") == F.col("l")).cast("double")).alias("agreement"))
    return out.withColumn("ok", (F.col("n") >= least_rows) & (F.col("mean_delta") <= 0.01) & (F.col("agreement") >= 0.99))


def unk_ratio(tokens: DataFrame, vocabulary: DataFrame, token: str = "token", limit: float = 0.05) -> DataFrame:
    """(n_tokens, unk_ratio, ok): the share of tokens that the vocabulary lacks."""
    known = vocabulary.select(F.col(token).alias("known")).distinct()
    counts = tokens.groupBy(token).agg(F.count("*").alias("n")).join(known, F.col(token) == F.col("known"), "left")
    out = counts.agg(F.sum("n").alias("n_tokens"), (F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("unk_ratio"))
    return out.withColumn("ok", F.col("unk_ratio") <= limit)


def top_error_tokens(rows: DataFrame, kind: str, words: Column, most: int = 12) -> DataFrame:
    """(kind, token, n, place): the most frequent words of each kind of error."""
    counts = rows.where(F.col(kind).isNotNull()).select(kind, F.explode(words).alias("token")).where("token <> ''").groupBy(kind, "token").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("n"), "token"))
    return counts.withColumn("place", place).where(F.col("place") <= most)


def release_gates(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """(gate, ok) of class metrics against a baseline's."""
    def pick(df: DataFrame, suffix: str) -> DataFrame:
        of = lambda label, c: F.max(F.when(F.col("label") == label, F.col(c)))
        return df.agg(of("scam", "fpr").alias(f"fpr{suffix}"), of("scam", "precision").alias(f"precision{suffix}"), of("scam", "recall").alias(f"recall{suffix}"), of("topic_crypto", "f1").alias(f"topic{suffix}"))

    both = pick(now, "").crossJoin(pick(baseline, "0"))  # a row each
    gates = {"scam_fpr": F.col("fpr") <= 0.02, "scam_precision": F.col("precision") >= 0.90, "scam_recall": F.col("recall") >= F.col("recall0") - 0.02, "topic_f1": F.col("topic") >= F.col("topic0")}
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("ok")) for k, v in gates.items()])).alias("g")).select("g.*")
