"""Confusion/metrics edge cases, golden facts, AUC/ROC and threshold sweep
checked against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netvigil.operators import curves, metrics, threshold


def _frame(spark, ys, scores, t=0.5):
    rows = [(i, int(y), float(s)) for i, (y, s) in enumerate(zip(ys, scores))]
    df = spark.createDataFrame(rows, "i long, y int, score double") if rows else \
        spark.createDataFrame([], "i long, y int, score double")
    return df.withColumn("pred", (F.col("score") >= t).cast("int"))


def test_golden_confusion_facts(spark):
    # published holdout: [[TN, FP], [FN, TP]] = [[7129, 292], [0, 150000]]
    n = 7129 + 292 + 150000
    df = spark.range(n).select(
        F.when(F.col("id") < 7421, 0).otherwise(1).alias("y"),
        F.when(F.col("id") < 7129, 0).otherwise(1).alias("pred"))
    m = metrics.binary_metrics(df, "y", "pred").first()
    assert round(m["accuracy"], 6) == 0.998145
    assert round(m["precision"], 6) == 0.998057
    assert m["recall_tpr"] == 1.0
    assert round(m["f1"], 6) == 0.999028
    assert round(m["fpr"], 6) == 0.039348
    assert round(m["tnr_specificity"], 6) == 0.960652
    assert round(m["mse"], 6) == 0.001855
    pct = {(r["actual"], r["predicted"]): r["pct"]
           for r in metrics.confusion_pct(df, "y", "pred", normalize="all").collect()}
    assert pct == {(0, 0): 0.0453, (0, 1): 0.0019, (1, 0): 0.0, (1, 1): 0.9529}


def test_metric_edge_cases(spark):
    one_class = _frame(spark, [1, 1, 1], [0.9, 0.2, 0.7])
    m = metrics.binary_metrics(one_class, "y", "pred").first()
    assert m["fpr"] == 0.0 and m["tnr_specificity"] == 0.0 and m["support_0"] == 0
    assert curves.auc(one_class, "y", "score").first()["auc"] is None
    no_pos_pred = _frame(spark, [0, 1, 0, 1], [0.1, 0.2, 0.3, 0.4])
    m = metrics.binary_metrics(no_pos_pred, "y", "pred").first()
    assert m["precision"] == 0.0 and m["f1"] == 0.0 and m["recall_tpr"] == 0.0
    same = _frame(spark, [0, 1, 0, 1], [0.5] * 4)
    assert curves.auc(same, "y", "score").first()["auc"] == 0.5
    empty = _frame(spark, [], [])
    c = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion(empty, "y", "pred").collect()}
    assert c == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 0}
    assert metrics.binary_metrics(empty, "y", "pred").first()["accuracy"] == 0.0


def _brute_auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def _brute_roc(ys, ss, drop=True):
    ys, ss = np.asarray(ys), np.asarray(ss)
    order = np.argsort(-ss, kind="mergesort")
    ys, ss = ys[order], ss[order]
    distinct = np.where(np.diff(ss))[0]
    idx = np.r_[distinct, ys.size - 1]
    tps = np.cumsum(ys)[idx]
    fps = 1 + idx - tps
    thr = ss[idx]
    if drop and len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    fps, tps = np.r_[0, fps], np.r_[0, tps]
    thr = np.r_[np.nan, thr]
    return fps / fps[-1], tps / tps[-1], thr


@pytest.mark.parametrize("buckets", [1, 5])
def test_auc_and_roc_match_brute_force(spark, buckets):
    rng = np.random.default_rng(7)
    n = 600
    ys = rng.integers(0, 2, n)
    ss = np.round(rng.random(n) * 0.6 + ys * 0.3, 2)  # many ties
    df = _frame(spark, ys, ss)
    auc = curves.auc(df, "y", "score", buckets=buckets).first()["auc"]
    assert math.isclose(auc, _brute_auc(ys, ss), rel_tol=1e-12)
    roc = curves.roc_curve(df, "y", "score", buckets=buckets).orderBy("idx").collect()
    fpr, tpr, thr = _brute_roc(ys, ss)
    assert len(roc) == len(fpr)
    assert [r["idx"] for r in roc] == list(range(len(fpr)))
    assert np.allclose([r["fpr"] for r in roc], fpr)
    assert np.allclose([r["tpr"] for r in roc], tpr)
    assert roc[0]["threshold"] is None
    assert np.allclose([r["threshold"] for r in roc[1:]], thr[1:])
    full = curves.roc_curve(df, "y", "score", drop_intermediate=False, buckets=buckets)
    assert full.count() == len(set(ss.tolist())) + 1
    thin = curves.thin_curve(full, 20).collect()
    assert 0 < len(thin) <= 20


def test_candidate_index_exact(spark):
    cands = threshold.candidate_thresholds()
    probes = sorted(set(cands + [math.nextafter(c, -1) for c in cands]
                        + [math.nextafter(c, 2) for c in cands] + [-1.0, 0.0, 0.005, 0.995, 1.0, 7.0]))
    df = spark.createDataFrame([(p,) for p in probes], "s double")
    got = df.select("s", threshold.candidate_index(F.col("s"), cands).alias("k")).collect()
    for r in got:
        assert r["k"] == sum(1 for c in cands if c <= r["s"]), r["s"]


@pytest.mark.parametrize("objective", ["f1", "youden"])
def test_best_threshold_brute_force(spark, objective):
    rng = np.random.default_rng(3)
    n = 800
    ys = rng.integers(0, 2, n)
    ss = np.clip(rng.normal(0.35 + 0.3 * ys, 0.2), 0, 1)
    df = _frame(spark, ys, ss)
    best_val, best_t = -1.0, 0.5
    for t in np.linspace(0.01, 0.99, 99):
        p = (ss >= t).astype(int)
        tp = int(((p == 1) & (ys == 1)).sum()); fp = int(((p == 1) & (ys == 0)).sum())
        fn = int(((p == 0) & (ys == 1)).sum()); tn = int(((p == 0) & (ys == 0)).sum())
        rec = tp / (tp + fn) if tp + fn else 0.0
        fpr = fp / (fp + tn) if fp + tn else 0.0
        f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
        val = f1 if objective == "f1" else rec - fpr
        if val > best_val:
            best_val, best_t = val, float(t)
    row = threshold.best_threshold(df, "y", "score", objective).first()
    assert row["threshold"] == best_t


def test_class_report_rows(spark):
    df = _frame(spark, [0, 0, 1, 1, 1], [0.1, 0.6, 0.7, 0.8, 0.2])
    rep = {r["class"]: r for r in metrics.class_report(df, "y", "pred", digits=4).collect()}
    assert rep["1"]["precision"] == round(2 / 3, 4) and rep["1"]["support"] == 3
    assert rep["accuracy"]["f1_score"] == 0.6 and rep["macro avg"]["support"] == 5


def test_minmax(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "d double")
    out = [r[0] for r in threshold.minmax_normalize(df, "d", "n").select("n").collect()]
    assert out == [0.0, 2.0 / (4 + 1e-8), 4.0 / (4 + 1e-8)]


def test_auto_summary_one_pass(spark):
    rng = np.random.default_rng(11)
    n = 500
    ys = [int(v) for v in rng.integers(0, 2, n)]
    ss = [float(v) for v in np.clip(rng.normal(0.4, 0.25, n), 0, 1)]
    rows = [(y if i % 9 else None, s if i % 13 else None) for i, (y, s) in enumerate(zip(ys, ss))]
    df = spark.createDataFrame(rows, "y int, score double")
    t = threshold.best_threshold_value(df, "y", "score", "youden")
    got = threshold.auto_summary(df, "y", "score", "youden").first()
    scored = [s for _, s in rows if s is not None]
    assert got["threshold"] == t
    assert got["total_records"] == n
    assert got["anomalies_detected"] == sum(s >= t for s in scored)
    assert got["normal_records"] == n - sum(s >= t for s in scored)  # a row without a score is normal


def test_auto_buckets_follow_input_bytes(spark, sf_dir, monkeypatch):
    from netvigil.operators.sizing import input_bytes
    from netvigil.plans.score_queries import labelled_flows

    lf = labelled_flows(spark, sf_dir)
    assert curves.bucket_count(lf) == 1
    one = curves.auc(lf, "y", "score").first()["auc"]
    b = [tuple(r) for r in curves.roc_curve(lf, "y", "score").orderBy("idx").collect()]
    monkeypatch.setattr(curves, "BYTES_PER_BUCKET", input_bytes(lf) // 4 + 1)
    assert curves.bucket_count(lf) == 4
    assert curves.auc(lf, "y", "score").first()["auc"] == one
    assert [tuple(r) for r in curves.roc_curve(lf, "y", "score").orderBy("idx").collect()] == b


def test_threshold_edges(spark):
    rows = [(1, float("inf")), (0, 3e7), (0, -5.0), (1, 0.7), (0, 0.2), (1, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "y int, score double")
    sw = {r["threshold"]: r for r in threshold.sweep(df, "y", "score").collect()}
    for t, r in sw.items():
        s = [(y, x) for y, x in rows if x is not None and x == x]
        assert (r["tp"], r["fp"]) == (sum(y and x >= t for y, x in s), sum(not y and x >= t for y, x in s))
    one = spark.createDataFrame([(0, 1.0)] * 5, "y int, score double")
    assert [r["threshold"] for r in threshold.best_threshold(one, "y", "score", "youden").collect()] == [0.5]


def test_summary_counts_rows_without_a_score_as_normal(spark):
    from netvigil.plans.reports import predict_report

    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, None), (0, float("nan"))], "y int, score double")
    r = predict_report(df, None, "score", 0.5).first()
    assert (r["total_records"], r["anomalies_detected"], r["normal_records"]) == (4, 1, 3)
