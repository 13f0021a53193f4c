"""Policies and metrics against loops over rows; fitted candidates on texts that tell their labels."""

import random

from curatrix.operators import sweep as W

CLASSES = ("scam", "topic_crypto")


def div(a, b):
    return a / b if b else 0.0


def expected(rows, policies):
    out = {}
    for model in {r[1] for r in rows}:
        for policy, rates in policies.items():
            at, told = {}, {}
            for k, c in enumerate(CLASSES):
                cal = [(r[4 + k], r[2 + k]) for r in rows if r[0] == "calib" and r[1] == model]
                neg, best = sum(not y for _, y in cal), None
                for t in {s for s, _ in cal} | {1.0}:
                    hits = [(s, y) for s, y in cal if s >= t] if t < 1.0 or any(s == 1.0 for s, _ in cal) else []
                    tp, fp = sum(y for _, y in hits), sum(not y for _, y in hits)
                    if div(fp, neg) <= rates[c] and (best is None or (tp, t) > best[:2]):
                        best = (tp, t, div(fp, neg))
                at[c] = best[1]
                told[f"{c}_threshold"], told[f"{c}_calib_fpr"] = best[1], best[2]
            hold = [r for r in rows if r[0] == "holdout" and r[1] == model]
            sets = []
            for r in hold:
                gold = {c for k, c in enumerate(CLASSES) if r[2 + k]} or {"clean"}
                hit = {c for k, c in enumerate(CLASSES) if r[4 + k] >= at[c]} or {"clean"}
                sets.append((gold, hit))
            f1, sums = [], [0, 0, 0]
            for c in (*CLASSES, "clean"):
                tp, fp, n = sum(c in g and c in h for g, h in sets), sum(c not in g and c in h for g, h in sets), sum(c in g for g, _ in sets)
                sums = [a + b for a, b in zip(sums, (tp, fp, n), strict=True)]
                f1.append(div(2 * tp, tp + fp + n))
                if c != "clean":
                    told |= {f"{c}_precision": div(tp, tp + fp), f"{c}_recall": div(tp, n), f"{c}_fpr": div(fp, len(sets) - n)}
            told |= {"micro_f1": div(2 * sums[0], sum(sums)), "macro_f1": sum(f1) / 3, "exact_match": sum(g == h for g, h in sets) / len(sets), "n": len(sets)}
            out[model, policy] = told
    return out


def test_policies_and_metrics_equal_loops(spark):
    draw = random.Random(3)
    rows = []
    for model in ("a", "b"):
        for k in range(600):
            y1, y2 = draw.random() < 0.2, draw.random() < 0.3
            rows.append(("calib" if k < 250 else "holdout", model, y1, y2, round(0.3 * y1 + 0.6 * draw.random(), 2), round(0.4 * y2 + 0.5 * draw.random(), 2)))
    df = spark.createDataFrame(rows, "split string, model string, y_scam boolean, y_topic_crypto boolean, s_scam double, s_topic_crypto double")
    policies = W.POLICIES | {"none": {"scam": 0.0, "topic_crypto": 1.0}}
    out = W.sweep_metrics(df.where("split = 'holdout'"), W.policy_thresholds(df.where("split = 'calib'"), policies, CLASSES), CLASSES).collect()
    want = expected(rows, policies)
    assert len(out) == len(want) == 6
    for r in out:
        for name, value in want[r.model, r.policy].items():
            assert abs(r[name] - value) < 1e-12, (r.model, r.policy, name)


def test_candidates_learn_from_train_alone(spark):
    kinds = [("free prize claim now", ["scam"]), ("coin chain token", ["topic_crypto"]), ("coin prize claim", ["scam", "topic_crypto"]), ("tea and bread", ["clean"]), (None, None)]
    rows = [(*kinds[k % 5], ["train", "calib", "holdout"][k // 5 % 3]) for k in range(300)]
    df = spark.createDataFrame(rows, "text string, labels array<string>, split string")
    found = W.sweep(df, "text", "labels", "split", [W.Candidate("all"), W.Candidate("words", ("words",), weighted=False)]).collect()
    assert {(r.model, r.policy) for r in found} == {(m, p) for m in ("all", "words") for p in W.POLICIES}
    assert all(r.n == 100 and r.exact_match == 1.0 and r.scam_fpr == 0.0 for r in found)
    clean = W.sweep(df.where("labels is null or array_contains(labels, 'clean')"), "text", "labels", "split", [W.Candidate("all")]).collect()
    assert [(r.scam_threshold, r.scam_recall, r.exact_match) for r in clean] == [(1.0, 0.0, 1.0)] * 2  # nothing to learn: no model, score 0
