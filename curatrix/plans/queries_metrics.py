"""Queries on metrics, calibration and thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from curatrix.functions import scores as S
from curatrix.functions import text as X
from curatrix.functions.labels import CLASSES
from curatrix.operators import metrics as M
from curatrix.operators import rules
from curatrix.operators import sweep as W
from curatrix.operators import thresholds as T
from curatrix.plans import fixtures as fx
from curatrix.plans.catalog import query

_AT = {"clean": 0.5, "topic_crypto": 0.6, "scam": 0.55}


def predicted(spark, sf, salt=""):
    df = fx.scored(spark, sf, salt)
    scores = {"clean": F.col("p_clean"), "topic_crypto": F.col("p_topic"), "scam": F.col("p_scam")}
    return df.withColumn("pred", S.predict_labels(scores, S.build_thresholds(_AT))).withColumn("label", S.decide(F.col("p_scam"), F.col("p_topic"), 0.55, 0.6))


_PRED = f"""{fx.SCORED}, pred AS (SELECT *, p_scam >= 0.55e0 AS ps, p_topic >= 0.6e0 AS pt, CASE WHEN p_scam >= 0.55e0 THEN 'scam' WHEN p_topic >= 0.6e0 THEN 'topic_crypto' ELSE 'clean' END AS label FROM scored)"""
_MULTI = f"""{_PRED}, cells AS (SELECT doc_id, text, lang, 'scam' AS label, gold_scam = 1 AS g, ps AS p FROM pred UNION ALL SELECT doc_id, text, lang, 'topic_crypto', gold_topic = 1, pt FROM pred
  UNION ALL SELECT doc_id, text, lang, 'clean', gold_scam = 0 AND gold_topic = 0, NOT ps AND NOT pt FROM pred)"""
_SINGLE = f"""{_PRED}, cells AS (SELECT doc_id, text, lang, c.label, gold = c.label AS g, pred.label = c.label AS p FROM pred, (VALUES ('clean'), ('topic_crypto'), ('scam')) c(label))"""
_COUNTS = "count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE g) AS support, count(*) AS n"
_DIV = lambda a, b: f"coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0e0)"
_RATES = f"{_DIV('tp', 'tp + fp')} AS precision, {_DIV('tp', 'tp + fn')} AS recall, {_DIV('2 * tp', '2 * tp + fp + fn')} AS f1, {_DIV('fp', 'n - support')} AS fpr, {_DIV('fn', 'support')} AS fnr"


def _scam():
    return F.col("gold_scam") == 1


def _topic():
    return F.col("gold_topic") == 1


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("predict_labels", f"WITH {_PRED} SELECT id, CASE WHEN ps AND pt THEN 'topic_crypto,scam' WHEN ps THEN 'scam' WHEN pt THEN 'topic_crypto' ELSE 'clean' END AS labels FROM pred")
def predict_labels(spark, sf):
    return predicted(spark, sf).select("id", F.concat_ws(",", "pred").alias("labels"))


@query("decide_hierarchical", f"WITH {_PRED} SELECT gold, label, count(*) AS n FROM pred GROUP BY ALL")
def decide_hierarchical(spark, sf):
    return predicted(spark, sf).groupBy("gold", "label").agg(F.count("*").alias("n"))


@query("two_stage_scores", f"WITH {fx.SCORED}, {fx.scored_sql('B', 'second')} SELECT a.id, a.p_scam, b.p_topic, 1 - greatest(a.p_scam, b.p_topic) AS p_clean FROM scored a JOIN second b ON a.id = b.id")
def two_stage_scores(spark, sf):
    a, b = fx.scored(spark, sf).select("id", "p_scam"), fx.scored(spark, sf, "B").select("id", "p_topic")
    return a.join(b, "id").withColumn("p_clean", 1 - F.greatest("p_scam", "p_topic"))


@query("multilabel_metrics", f"WITH {_MULTI}, c AS (SELECT label, {_COUNTS} FROM cells GROUP BY 1) SELECT label, tp, fp, fn, support, n, {_RATES} FROM c")
def multilabel_metrics(spark, sf):
    return M.multilabel_metrics(predicted(spark, sf), "multi", "pred")


@query("multilabel_summary", f"""WITH {_MULTI}, c AS (SELECT label, {_COUNTS} FROM cells GROUP BY 1), r AS (SELECT *, {_RATES} FROM c)
SELECT round({_DIV('sum(tp)', 'sum(tp) + sum(fp)')}, 9) AS micro_precision, round({_DIV('sum(tp)', 'sum(tp) + sum(fn)')}, 9) AS micro_recall, round({_DIV('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')}, 9) AS micro_f1, round(avg(f1), 9) AS macro_f1 FROM r""")
def multilabel_summary(spark, sf):
    return rounded(M.summary(M.multilabel_metrics(predicted(spark, sf), "multi", "pred")), "micro_precision", "micro_recall", "micro_f1", "macro_f1")


@query("exact_match", f"WITH {_PRED} SELECT round(avg(CASE WHEN ps = (gold_scam = 1) AND pt = (gold_topic = 1) THEN 1e0 ELSE 0e0 END), 9) AS exact_match, count(*) AS n FROM pred")
def exact_match(spark, sf):
    return rounded(M.exact_match(predicted(spark, sf), "multi", "pred"), "exact_match")


@query("single_label_metrics", f"WITH {_SINGLE}, c AS (SELECT label, {_COUNTS} FROM cells GROUP BY 1) SELECT label, tp, fp, fn, support, n, {_RATES} FROM c")
def single_label_metrics(spark, sf):
    return M.single_label_metrics(predicted(spark, sf), "gold", "label")


@query("confusion_matrix", f"""WITH {_PRED}, a(actual) AS (VALUES ('clean'), ('topic_crypto'), ('scam')) SELECT actual, count(*) FILTER (WHERE label = 'clean') AS clean, count(*) FILTER (WHERE label = 'topic_crypto') AS topic_crypto, count(*) FILTER (WHERE label = 'scam') AS scam
FROM a LEFT JOIN pred ON gold = actual GROUP BY 1""")
def confusion_matrix(spark, sf):
    return M.confusion_matrix(predicted(spark, sf), "gold", "label")


@query("binary_metrics", f"WITH {fx.SCORED} SELECT count(*) FILTER (WHERE gold_scam = 1 AND p_scam >= 0.6e0) AS tp, count(*) FILTER (WHERE gold_scam = 0 AND p_scam >= 0.6e0) AS fp, count(*) FILTER (WHERE gold_scam = 1 AND p_scam < 0.6e0) AS fn, count(*) FILTER (WHERE gold_scam = 0 AND p_scam < 0.6e0) AS tn FROM scored")
def binary_metrics(spark, sf):
    return M.binary_metrics(fx.scored(spark, sf), _scam(), F.col("p_scam"), 0.6)


@query("subgroup_metrics", f"""WITH {_SINGLE}, s AS (SELECT unnest(list_filter(['all', CASE WHEN length(text) < 40 THEN 'short' END, 'without_url', CASE WHEN lang = 'en' THEN 'seen_handle' ELSE 'unseen_handle' END], lambda x: x IS NOT NULL)) AS subgroup, label, g, p FROM cells),
c AS (SELECT subgroup, label, {_COUNTS} FROM s GROUP BY ALL), r AS (SELECT subgroup, label, tp, fp, fn, support, n, {_RATES} FROM c), w AS (SELECT * FROM (VALUES ('all'), ('short'), ('with_url'), ('without_url'), ('seen_handle'), ('unseen_handle')) a(subgroup), (VALUES ('clean'), ('topic_crypto'), ('scam')) b(label))
SELECT subgroup, label, coalesce(n, 0) AS n, coalesce(tp, -1) AS tp, coalesce(fp, -1) AS fp, coalesce(fn, -1) AS fn, precision, recall FROM w LEFT JOIN r USING (subgroup, label)""")
def subgroup_metrics(spark, sf):
    df = rules.subgroup_flags(predicted(spark, sf), "text", X.has_url(F.col("text")), F.col("lang") == "en")
    out = M.subgroup_metrics(df, "subgroups", ["all", "short", "with_url", "without_url", "seen_handle", "unseen_handle"], "gold", "label")
    return out.select("subgroup", "label", "n", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("tp", "fp", "fn")], "precision", "recall")


_STEPS = """steps AS (SELECT s, sum(y) OVER (ORDER BY s DESC) AS tp, sum(c) OVER (ORDER BY s DESC) AS k FROM (SELECT {p} AS s, sum({y}) AS y, count(*) AS c FROM scored GROUP BY 1))"""


@query("pr_auc", f"""WITH {fx.SCORED}, {_STEPS.format(p='p_scam', y='gold_scam')}, pts AS (SELECT s, tp / (SELECT sum(gold_scam) FROM scored) AS r, tp / k AS p FROM steps)
SELECT round(sum(a), 9) AS pr_auc FROM (SELECT (r - lag(r, 1, 0) OVER (ORDER BY s DESC)) * (p + lag(p, 1, 0) OVER (ORDER BY s DESC)) / 2 AS a FROM pts)""")
def pr_auc(spark, sf):
    return rounded(M.pr_auc(fx.scored(spark, sf), "p_scam", _scam()), "pr_auc")


_BIN = "CASE " + " ".join(f"WHEN p_scam < {e!r}::DOUBLE THEN {k}" for k, e in enumerate(M.EDGES[1:10])) + " ELSE 9 END"
_BINS = f"""{fx.SCORED}, b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(p_scam) AS mean_conf, avg(gold_scam) AS acc FROM scored GROUP BY 1)"""


@query("calibration_bins", f"WITH {_BINS} SELECT CAST(r.bin AS INTEGER) AS bin, coalesce(n, 0) AS n, round(coalesce(mean_conf, 0e0), 9) AS mean_conf, round(coalesce(acc, 0e0), 9) AS empirical_acc FROM (SELECT range AS bin FROM range(10)) r LEFT JOIN b ON b.bin = r.bin")
def calibration_bins(spark, sf):
    return rounded(M.calibration_bins(fx.scored(spark, sf), "p_scam", _scam()), "mean_conf", "empirical_acc")


@query("ece", f"WITH {_BINS} SELECT round(sum(n * abs(mean_conf - acc)) / sum(n), 9) AS ece FROM b")
def ece(spark, sf):
    return rounded(M.ece(M.calibration_bins(fx.scored(spark, sf), "p_scam", _scam())), "ece")


@query("brier", f"WITH {fx.SCORED} SELECT round(avg(pow(p_scam - gold_scam, 2)), 9) AS brier FROM scored")
def brier(spark, sf):
    return rounded(M.brier(fx.scored(spark, sf), "p_scam", _scam()), "brier")


_CLIP = "greatest(1e-7, least(1 - 1e-7, {p}))"


@query("nll", f"WITH {fx.SCORED}, q AS (SELECT gold_scam, {_CLIP.format(p='p_scam')} AS p FROM scored) SELECT round(avg(-CASE WHEN gold_scam = 1 THEN ln(p) ELSE ln(1 - p) END), 9) AS nll FROM q")
def nll(spark, sf):
    return rounded(M.nll(fx.scored(spark, sf), "p_scam", _scam()), "nll")


def _logits(spark, sf):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p_scam")))
    return fx.scored(spark, sf).withColumn("logit", F.ln(p / (1 - p)))


_SCALED = f"""{fx.SCORED}, l AS (SELECT id, gold_scam, ln(p / (1 - p)) AS logit FROM (SELECT id, gold_scam, greatest(1e-6, least(1 - 1e-6, p_scam)) AS p FROM scored)), grid AS (SELECT unnest({M.TEMPERATURES!r}::DOUBLE[]) AS t),
q AS (SELECT t, gold_scam, {_CLIP.format(p='1 / (1 + exp(-logit / t))')} AS p FROM l, grid), n AS (SELECT t, avg(-CASE WHEN gold_scam = 1 THEN ln(p) ELSE ln(1 - p) END) AS nll FROM q GROUP BY 1), best AS (SELECT t AS temperature, nll FROM n ORDER BY nll, t LIMIT 1)"""


@query("temperature_scaling", f"WITH {_SCALED} SELECT temperature, round(nll, 9) AS nll FROM best")
def temperature_scaling(spark, sf):
    return rounded(M.temperature_scaling(_logits(spark, sf), "logit", _scam()), "nll")


@query("calibrated_probabilities", f"WITH {_SCALED} SELECT id, round(1 / (1 + exp(-logit / temperature)), 9) AS p FROM l, best")
def calibrated_probabilities(spark, sf):
    df = _logits(spark, sf)
    best = M.temperature_scaling(df, "logit", _scam())
    return df.crossJoin(F.broadcast(best)).select("id", F.round(M.tempered(F.col("logit"), F.col("temperature")), 9).alias("p"))  # one row


def _seeds(spark, sf):
    parts = [fx.scored(spark, sf, f"seed{s}").select("doc_id", "id", F.lit(s).alias("seed"), F.array("p_scam", "p_topic").alias("scores")) for s in (13, 42, 77)]
    return reduce(lambda a, b: a.unionByName(b), parts).where("not (seed = 77 and doc_id % 10 = 0)")


_SEEDS = f"{fx.POSTS}, {fx.scored_sql('seed13', 'a')}, {fx.scored_sql('seed42', 'b')}, {fx.scored_sql('seed77', 'c')}, means AS (SELECT a.id, a.gold, (a.p_scam + b.p_scam + c.p_scam) / 3 AS s, (a.p_topic + b.p_topic + c.p_topic) / 3 AS t FROM a JOIN b USING (id) JOIN c ON c.id = a.id WHERE a.doc_id % 10 <> 0)"


@query("ensemble_mean", f"WITH {_SEEDS} SELECT id, round(s, 9) AS p_scam, round(t, 9) AS p_topic FROM means")
def ensemble_mean(spark, sf):
    df = M.ensemble_mean(_seeds(spark, sf), "id", "scores", 3)
    return df.select("id", F.round(F.col("scores")[0], 9).alias("p_scam"), F.round(F.col("scores")[1], 9).alias("p_topic"))


@query("embedding_means", """WITH e AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings) SELECT label, pos, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM e GROUP BY ALL""")
def embedding_means(spark, sf):
    df = fx.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return df.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("ensemble_eval", f"""WITH {_SEEDS}, cells AS (SELECT c.label, gold = c.label AS g, CASE WHEN s >= 0.5e0 THEN 'scam' WHEN t >= 0.5e0 THEN 'topic_crypto' ELSE 'clean' END = c.label AS p FROM means, (VALUES ('clean'), ('topic_crypto'), ('scam')) c(label)),
k AS (SELECT label, {_COUNTS} FROM cells GROUP BY 1) SELECT label, tp, fp, fn, support, n, {_RATES} FROM k""")
def ensemble_eval(spark, sf):
    means = M.ensemble_mean(_seeds(spark, sf), "id", "scores", 3).withColumn("label", S.decide(F.col("scores")[0], F.col("scores")[1], 0.5, 0.5))
    return M.single_label_metrics(fx.scored(spark, sf).select("id", "gold").join(means, "id"), "gold", "label")


@query("model_parity", f"""WITH {fx.SCORED}, {fx.scored_sql('B', 'second')}, j AS (SELECT (abs(a.p_scam - b.p_scam) + abs(a.p_topic - b.p_topic)) / 2 AS d, CASE WHEN (a.p_scam >= 0.5e0) = (b.p_scam >= 0.5e0) THEN 1e0 ELSE 0e0 END AS e FROM scored a JOIN second b ON a.id = b.id)
SELECT count(*) AS n, round(avg(d), 9) AS mean_delta, round(avg(e), 9) AS agreement, count(*) >= 1000 AND avg(d) <= 0.01e0 AND avg(e) >= 0.99e0 AS ok FROM j""")
def model_parity(spark, sf):
    side = lambda salt: fx.scored(spark, sf, salt).select("id", "p_scam", "p_topic", (F.col("p_scam") >= 0.5).alias("label"))
    return rounded(M.model_parity(side(""), side("B"), "id"), "mean_delta", "agreement")


_WORDS = "string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')"


def _words():
    return F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")


@query("unk_ratio_audit", f"""WITH v AS (SELECT DISTINCT unnest({_WORDS}) AS token FROM documents WHERE doc_id % 3 = 0), t AS (SELECT unnest({_WORDS}) AS token FROM documents)
SELECT CAST(count(*) AS BIGINT) AS n_tokens, round(count(*) FILTER (WHERE v.token IS NULL) / count(*), 9) AS unk_ratio, count(*) FILTER (WHERE v.token IS NULL) / count(*) <= 0.05e0 AS ok FROM t LEFT JOIN v ON t.token = v.token WHERE t.token <> ''""")
def unk_ratio_audit(spark, sf):
    docs = fx.table(spark, sf, "documents")
    tokens = docs.select("doc_id", F.explode(_words()).alias("token")).where("token <> ''")
    return rounded(M.unk_ratio(tokens, tokens.where("doc_id % 3 = 0")), "unk_ratio")


@query("top_error_tokens", f"""WITH {_PRED}, e AS (SELECT CASE WHEN label = 'scam' THEN 'fp' ELSE 'fn' END AS kind, unnest({_WORDS}) AS token FROM pred WHERE (gold = 'scam') <> (label = 'scam')),
c AS (SELECT kind, token, count(*) AS n FROM e WHERE token <> '' GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY n DESC, token) AS INTEGER) AS place FROM c) SELECT kind, token, n, place FROM r WHERE place <= 12""")
def top_error_tokens(spark, sf):
    wrong = (F.col("gold") == "scam") != (F.col("label") == "scam")
    df = predicted(spark, sf).withColumn("kind", F.when(wrong, F.when(F.col("label") == "scam", "fp").otherwise("fn")))
    return M.top_error_tokens(df, "kind", _words())


@query("release_gates", f"""WITH {_SINGLE}, {fx.scored_sql('B', 'second')}, cells0 AS (SELECT c.label, gold = c.label AS g, CASE WHEN p_scam >= 0.55e0 THEN 'scam' WHEN p_topic >= 0.6e0 THEN 'topic_crypto' ELSE 'clean' END = c.label AS p FROM second, (VALUES ('clean'), ('topic_crypto'), ('scam')) c(label)),
c AS (SELECT 1 AS now, label, {_COUNTS} FROM cells GROUP BY ALL UNION ALL SELECT 0, label, {_COUNTS} FROM cells0 GROUP BY ALL), r AS (SELECT *, {_RATES} FROM c),
s AS (SELECT n.fpr, n.precision, n.recall, o.recall AS recall0, t.f1, u.f1 AS f10 FROM r n, r o, r t, r u WHERE n.now = 1 AND n.label = 'scam' AND o.now = 0 AND o.label = 'scam' AND t.now = 1 AND t.label = 'topic_crypto' AND u.now = 0 AND u.label = 'topic_crypto')
SELECT 'scam_fpr' AS gate, fpr <= 0.02e0 AS ok FROM s UNION ALL SELECT 'scam_precision', precision >= 0.9e0 FROM s UNION ALL SELECT 'scam_recall', recall >= recall0 - 0.02e0 FROM s UNION ALL SELECT 'topic_f1', f1 >= f10 FROM s""")
def release_gates(spark, sf):
    now, baseline = (M.single_label_metrics(predicted(spark, sf, salt), "gold", "label") for salt in ("", "B"))
    return M.release_gates(now, baseline)


def _long(spark, sf, salts=("",)):
    """A row for each model, post and class: model, label, score, positive."""
    parts = []
    for salt in salts:
        cells = F.array(F.struct(F.lit("scam").alias("label"), F.col("p_scam").alias("score"), _scam().alias("positive")), F.struct(F.lit("topic_crypto").alias("label"), F.col("p_topic").alias("score"), _topic().alias("positive")))
        parts.append(fx.scored(spark, sf, salt).select("doc_id", F.lit(f"m{salt}").alias("model"), F.explode(cells).alias("c")).select("doc_id", "model", "c.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _long_sql(salts=("",)):
    parts = [f"SELECT doc_id, 'm{s}' AS model, 'scam' AS label, p_scam AS score, gold_scam AS y FROM m{s} UNION ALL SELECT doc_id, 'm{s}', 'topic_crypto', p_topic, gold_topic FROM m{s}" for s in salts]
    return f"{fx.POSTS}, {', '.join(fx.scored_sql(s, f'm{s}') for s in salts)}, long AS ({' UNION ALL '.join(parts)})"


_TUNE = """steps AS (SELECT model, label, score AS threshold, sum(y) OVER w AS tp, sum(c - y) OVER w AS fp FROM (SELECT model, label, score, sum(y) AS y, count(*) AS c FROM long GROUP BY ALL) WINDOW w AS (PARTITION BY model, label ORDER BY score DESC)),
cand AS (SELECT * FROM steps UNION ALL SELECT DISTINCT model, label, 1e0, 0, 0 FROM long), tot AS (SELECT model, label, sum(y) AS pos, count(*) - sum(y) AS neg FROM long GROUP BY ALL),
ok AS (SELECT *, row_number() OVER (PARTITION BY model, label ORDER BY tp DESC, threshold DESC) AS place FROM cand JOIN tot USING (model, label) WHERE coalesce(fp / nullif(neg, 0), 0) <= {target})"""
_TUNED = f"threshold, round({_DIV('fp', 'neg')}, 9) AS fpr, round({_DIV('tp', 'pos')}, 9) AS recall, round({_DIV('tp', 'tp + fp')}, 9) AS precision FROM ok WHERE place = 1"


@query("tune_fpr_constrained", f"WITH {_long_sql()}, {_TUNE.format(target='0.02e0')} SELECT label, {_TUNED}")
def tune_fpr_constrained(spark, sf):
    return rounded(T.tune_fpr(_long(spark, sf), ["label"], "score", F.col("positive"), F.lit(0.02)), "fpr", "recall", "precision")


@query("tune_two_targets", f"WITH {_long_sql()}, {_TUNE.format(target=chr(39).join(['CASE label WHEN ', 'scam', ' THEN 0.02e0 ELSE 0.1e0 END']))} SELECT label, {_TUNED}")
def tune_two_targets(spark, sf):
    target = F.when(F.col("label") == "scam", 0.02).otherwise(0.1)
    return rounded(T.tune_fpr(_long(spark, sf), ["label"], "score", F.col("positive"), target), "fpr", "recall", "precision")


@query("compare_models_fpr", f"WITH {_long_sql(('', 'B', 'C'))}, {_TUNE.format(target='0.05e0')} SELECT model, label, {_TUNED}")
def compare_models_fpr(spark, sf):
    return rounded(T.tune_fpr(_long(spark, sf, ("", "B", "C")), ["model", "label"], "score", F.col("positive"), F.lit(0.05)), "fpr", "recall", "precision")


@query("tune_f1_grid", f"""WITH {_long_sql()}, g AS (SELECT unnest({T.F1_GRID!r}::DOUBLE[]) AS t), f AS (SELECT label, t, {_DIV('2 * count(*) FILTER (WHERE y = 1 AND score >= t)', 'count(*) FILTER (WHERE score >= t) + sum(y)')} AS f1 FROM long, g GROUP BY ALL)
SELECT label, t AS threshold, round(f1, 9) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) AS place FROM f) WHERE place = 1""")
def tune_f1_grid(spark, sf):
    return rounded(T.tune_f1(_long(spark, sf), ["label"], "score", F.col("positive")), "f1")


@query("tune_lowest_meeting_fpr", f"""WITH {_long_sql()}, g AS (SELECT unnest({T.FPR_LIST!r}::DOUBLE[]) AS t), f AS (SELECT label, t, count(*) FILTER (WHERE y = 0 AND score >= t) / (count(*) - sum(y)) AS fpr FROM long, g GROUP BY ALL)
SELECT label, t AS threshold, round(fpr, 9) AS fpr FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY t) AS place FROM f WHERE fpr <= 0.05e0) WHERE place = 1""")
def tune_lowest_meeting_fpr(spark, sf):
    return rounded(T.tune_lowest(_long(spark, sf), ["label"], "score", F.col("positive")), "fpr")


@query("tune_pair_grid", f"""WITH {fx.SCORED}, g AS (SELECT unnest({T.PAIR_GRID!r}::DOUBLE[]) AS t), p AS (SELECT a.t AS a, b.t AS b, gold, CASE WHEN p_scam >= a.t THEN 'scam' WHEN p_topic >= b.t THEN 'topic_crypto' ELSE 'clean' END AS label FROM scored, g a, g b),
m AS (SELECT a, b, {_DIV("count(*) FILTER (WHERE gold = 'scam' AND label = 'scam')", "count(*) FILTER (WHERE gold = 'scam')")} AS recall, {_DIV("count(*) FILTER (WHERE gold = 'scam' AND label = 'scam')", "count(*) FILTER (WHERE label = 'scam')")} AS precision,
  {_DIV("count(*) FILTER (WHERE gold <> 'scam' AND label = 'scam')", "count(*) FILTER (WHERE gold <> 'scam')")} AS fpr,
  round(({' + '.join(_DIV(f"2 * count(*) FILTER (WHERE gold = '{c}' AND label = '{c}')", f"count(*) FILTER (WHERE gold = '{c}') + count(*) FILTER (WHERE label = '{c}')") for c in CLASSES)}) / 3, 12) AS macro_f1 FROM p GROUP BY ALL)
SELECT a AS scam_threshold, b AS topic_threshold, round(recall, 9) AS recall, round(precision, 9) AS precision, round(macro_f1, 9) AS macro_f1, '' AS note FROM m WHERE fpr <= 0.1e0 ORDER BY m.recall DESC, m.precision DESC, m.macro_f1 DESC, a, b LIMIT 1""")
def tune_pair_grid(spark, sf):
    return rounded(T.tune_pair_grid(fx.scored(spark, sf), "p_scam", "p_topic", "gold", 0.1), "recall", "precision", "macro_f1")


@query("threshold_transfer", f"""WITH {_long_sql()}, l AS (SELECT * FROM long), cal AS (SELECT * FROM l WHERE {fx.split_sql()} = 'valid'), {_TUNE.format(target='0.05e0').replace('FROM long', 'FROM cal')},
best AS (SELECT label, threshold FROM ok WHERE place = 1) SELECT l.label, threshold, round({_DIV('count(*) FILTER (WHERE y = 0 AND score >= threshold)', 'count(*) FILTER (WHERE y = 0)')}, 9) AS fpr, round({_DIV('count(*) FILTER (WHERE y = 1 AND score >= threshold)', 'count(*) FILTER (WHERE y = 1)')}, 9) AS recall
FROM l JOIN best USING (label) WHERE {fx.split_sql()} = 'holdout' GROUP BY ALL""")
def threshold_transfer(spark, sf):
    rows = fx.with_split(_long(spark, sf))
    best = T.tune_fpr(rows.where("split = 'valid'"), ["label"], "score", F.col("positive"), F.lit(0.05)).select("label", "threshold")
    hit = F.col("score") >= F.col("threshold")
    at = rows.where("split = 'holdout'").join(F.broadcast(best), "label")  # a row for each label
    out = at.groupBy("label", "threshold").agg(S.safe_div(F.count_if(~F.col("positive") & hit), F.count_if(~F.col("positive"))).alias("fpr"), S.safe_div(F.count_if(F.col("positive") & hit), F.count_if(F.col("positive"))).alias("recall"))
    return rounded(out, "fpr", "recall")


@query("score_grid_table", f"""WITH {_long_sql(('', 'B', 'C'))}, g AS (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]) AS cut), c AS (SELECT model, cut, label, count(*) FILTER (WHERE y = 1 AND score >= cut) AS tp, count(*) FILTER (WHERE y = 0 AND score >= cut) AS fp, sum(y) AS pos, count(*) - sum(y) AS neg FROM long, g GROUP BY ALL)
SELECT model, cut, label, tp, fp, round({_DIV('tp', 'pos')}, 9) AS recall, round({_DIV('fp', 'neg')}, 9) AS fpr FROM c""")
def score_grid_table(spark, sf):
    out = T.grid_counts(_long(spark, sf, ("", "B", "C")), ["model", "label"], "score", F.col("positive"), [0.5, 0.7, 0.9]).withColumnRenamed("threshold", "cut")
    return rounded(out.withColumn("recall", S.safe_div(F.col("tp"), F.col("pos"))).withColumn("fpr", S.safe_div(F.col("fp"), F.col("neg"))), "recall", "fpr").drop("pos", "neg")


def _sweep_sql(salts=("", "B", "C")):
    hold = " UNION ALL ".join(f"SELECT 'm{x}' AS model, doc_id, p_scam, p_topic, gold_scam = 1 AS y1, gold_topic = 1 AS y2 FROM m{x}" for x in salts)
    tuned = _TUNE.format(target="CASE WHEN label = 'scam' THEN 0.02e0 WHEN model LIKE '%/strict' THEN 0.03e0 ELSE 0.2e0 END").replace("FROM long", "FROM cal")
    counts = ", ".join(f"count(*) FILTER (WHERE y{k} AND h{k}) AS tp{k}, count(*) FILTER (WHERE NOT y{k} AND h{k}) AS fp{k}, count(*) FILTER (WHERE y{k}) AS n{k}" for k in (1, 2, 3))
    told = ", ".join(
        f"t{k} AS {c}_threshold, round(f{k}, 9) AS {c}_calib_fpr, round({_DIV(f'tp{k}', f'tp{k} + fp{k}')}, 9) AS {c}_precision, round({_DIV(f'tp{k}', f'n{k}')}, 9) AS {c}_recall, round({_DIV(f'fp{k}', f'n - n{k}')}, 9) AS {c}_fpr"
        for k, c in ((1, "scam"), (2, "topic_crypto"))
    )
    f1 = " + ".join(_DIV(f"2 * tp{k}", f"tp{k} + fp{k} + n{k}") for k in (1, 2, 3))
    return f"""WITH {_long_sql(salts)}, cal AS (SELECT model || '/' || policy AS model, label, score, y FROM long, (VALUES ('strict'), ('relaxed')) p(policy) WHERE {fx.split_sql()} = 'calib'), {tuned},
best AS (SELECT model, label, threshold, {_DIV('fp', 'neg')} AS fpr FROM ok WHERE place = 1), thr AS (SELECT model AS k, max(threshold) FILTER (WHERE label = 'scam') AS t1, max(threshold) FILTER (WHERE label <> 'scam') AS t2, max(fpr) FILTER (WHERE label = 'scam') AS f1, max(fpr) FILTER (WHERE label <> 'scam') AS f2 FROM best GROUP BY 1),
hold AS ({hold}), cells AS (SELECT k, t1, t2, f1, f2, y1, y2, NOT y1 AND NOT y2 AS y3, p_scam >= t1 AS h1, p_topic >= t2 AS h2, p_scam < t1 AND p_topic < t2 AS h3 FROM hold JOIN thr ON split_part(k, '/', 1) = model WHERE {fx.split_sql()} = 'holdout'),
agg AS (SELECT k, t1, t2, f1, f2, count(*) AS n, avg(CASE WHEN y1 = h1 AND y2 = h2 THEN 1e0 ELSE 0e0 END) AS same, {counts} FROM cells GROUP BY ALL)
SELECT split_part(k, '/', 1) AS model, split_part(k, '/', 2) AS policy, {told}, round({_DIV('2 * (tp1 + tp2 + tp3)', 'tp1 + tp2 + tp3 + fp1 + fp2 + fp3 + n1 + n2 + n3')}, 9) AS micro_f1, round(({f1}) / 3, 9) AS macro_f1, round(same, 9) AS exact_match, n FROM agg"""


def _round_sweep(df):
    return rounded(df, *[c for c in df.columns if c not in ("model", "policy", "n") and not c.endswith("_threshold")])


@query("sweep_policies", _sweep_sql())
def sweep_policies(spark, sf):
    """Thresholds by policy and metrics of three models' scores."""
    parts = [fx.with_split(fx.scored(spark, sf, x)).select("split", F.lit(f"m{x}").alias("model"), _scam().alias("y_scam"), _topic().alias("y_topic_crypto"), F.col("p_scam").alias("s_scam"), F.col("p_topic").alias("s_topic_crypto")) for x in ("", "B", "C")]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    found = W.policy_thresholds(rows.where("split = 'calib'"), W.POLICIES, ("scam", "topic_crypto"))
    return _round_sweep(W.sweep_metrics(rows.where("split = 'holdout'"), found, ("scam", "topic_crypto")))


#: Kinds of features, strength of the penalty, and weights of classes.
SWEPT = [W.Candidate("all"), W.Candidate("words", ("words",)), W.Candidate("words_chars_reg10", ("words", "chars"), reg=0.1), W.Candidate("pairs_plain", ("words", "pairs"), weighted=False)]


@query("hyperparam_sweep_table")
def hyperparam_sweep_table(spark, sf):
    """Models fitted on train, thresholds set on calib, rows of holdout reported."""
    return _round_sweep(W.sweep(fx.with_split(fx.scored(spark, sf)).select("text", "multi", "split"), "text", "multi", "split", SWEPT))


@query("bakeoff_rank", f"""WITH {_long_sql(('', 'B', 'C'))}, c AS (SELECT model, count(*) FILTER (WHERE label = 'scam' AND y = 1 AND score >= 0.5e0) AS stp, count(*) FILTER (WHERE label = 'scam' AND y = 0 AND score >= 0.5e0) AS sfp, count(*) FILTER (WHERE label = 'scam' AND y = 1) AS pos, count(*) FILTER (WHERE label = 'scam' AND y = 0) AS neg,
  count(*) FILTER (WHERE y = 1 AND score >= 0.5e0) AS tp, count(*) FILTER (WHERE score >= 0.5e0) AS hits, sum(y) AS ys FROM long GROUP BY 1),
k AS (SELECT *, ({_DIV('2 * stp', 'stp + sfp + pos')} + {_DIV('2 * (tp - stp)', 'hits - stp - sfp + ys - pos')}) / 2 AS macro FROM c)
SELECT model AS name, CASE WHEN model = 'm' THEN 'linear' ELSE 'tree' END AS model_type, CAST(row_number() OVER (ORDER BY {_DIV('sfp', 'neg')}, {_DIV('stp', 'pos')} DESC, {_DIV('2 * tp', 'hits + ys')} DESC, macro DESC, model) AS INTEGER) AS place,
  CAST(row_number() OVER (PARTITION BY model = 'm' ORDER BY {_DIV('sfp', 'neg')}, {_DIV('stp', 'pos')} DESC, {_DIV('2 * tp', 'hits + ys')} DESC, macro DESC, model) AS INTEGER) AS place_in_kind, round(macro, 9) AS macro_f1 FROM k""")
def bakeoff_rank(spark, sf):
    scam, hit, pos = F.col("label") == "scam", F.col("score") >= 0.5, F.col("positive")
    f1 = lambda of: S.safe_div(2 * F.count_if(of & pos & hit), F.count_if(of & hit) + F.count_if(of & pos))
    out = _long(spark, sf, ("", "B", "C")).groupBy(F.col("model").alias("name")).agg(
        S.safe_div(F.count_if(scam & ~pos & hit), F.count_if(scam & ~pos)).alias("scam_fpr"), S.safe_div(F.count_if(scam & pos & hit), F.count_if(scam & pos)).alias("scam_recall"),
        f1(F.lit(True)).alias("micro_f1"), ((f1(scam) + f1(~scam)) / 2).alias("macro_f1"),
    )
    out = out.withColumn("model_type", F.when(F.col("name") == "m", "linear").otherwise("tree"))
    return rounded(T.bakeoff_rank(out), "macro_f1").select("name", "model_type", "place", "place_in_kind", "macro_f1")
