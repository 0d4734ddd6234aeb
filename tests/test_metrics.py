import math
import random

import numpy as np
from pyspark.sql import functions as F

from tabsight.operators import metrics as M


def _imbalanced(spark):
    # 90 negatives, 10 positives; tn 88, fp 2, fn 3, tp 7
    rows = [(0, 0, 0.1)] * 88 + [(0, 1, 0.7)] * 2 + [(1, 0, 0.3)] * 3 + [(1, 1, 0.9)] * 7
    return spark.createDataFrame(rows, "y int, pred int, p double")


def test_imbalanced_confusion_and_rates(spark):
    r = M.classification_metrics(_imbalanced(spark), "y", "pred", None, "1").first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (88, 2, 3, 7)
    assert math.isclose(r["precision_positive"], 7 / 9)
    assert math.isclose(r["specificity"], 88 / 90)
    assert math.isclose(r["recall_positive"], 0.7)
    rk = M.ranking_metrics(_imbalanced(spark), "y", "p").first()
    assert math.isclose(rk["prevalence"], 0.10)
    assert rk["is_imbalanced"]


def _brute_auc(y, p):
    pos = [a for a, b in zip(p, y) if b == 1]
    neg = [a for a, b in zip(p, y) if b == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_rec = 0.0, 0.0
    for t in order:
        tp = sum(1 for a, b in zip(p, y) if a >= t and b == 1)
        fp = sum(1 for a, b in zip(p, y) if a >= t and b == 0)
        rec = tp / P
        ap += (rec - prev_rec) * (tp / (tp + fp))
        prev_rec = rec
    return ap


def _sk_roc(y, p):
    """Reference semantics: distinct thresholds descending, collinear points dropped, origin prepended."""
    order = sorted(set(p), reverse=True)
    fps = [sum(1 for a, b in zip(p, y) if a >= t and b == 0) for t in order]
    tps = [sum(1 for a, b in zip(p, y) if a >= t and b == 1) for t in order]
    if len(fps) > 2:
        keep = [0] + [i for i in range(1, len(fps) - 1)
                      if (fps[i + 1] - 2 * fps[i] + fps[i - 1]) != 0 or (tps[i + 1] - 2 * tps[i] + tps[i - 1]) != 0] + [len(fps) - 1]
        fps = [fps[i] for i in keep]
        tps = [tps[i] for i in keep]
    fps, tps = [0] + fps, [0] + tps
    fpr = [f / fps[-1] for f in fps]
    tpr = [t / tps[-1] for t in tps]
    idx = np.linspace(0, len(fpr) - 1, min(len(fpr), 50), dtype=int)
    return [(fpr[i], tpr[i]) for i in idx]


def test_ranking_and_roc_points_vs_brute_force(spark):
    rng = random.Random(3)
    y = [rng.choice([0, 0, 1]) for _ in range(700)]
    p = [round(min(0.99, max(0.0, 0.3 * b + rng.random() * 0.7)), 2) for b in y]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    r = M.ranking_metrics(df, "y", "p").first()
    assert math.isclose(r["roc_auc"], _brute_auc(y, p), rel_tol=1e-12)
    assert math.isclose(r["pr_auc"], _brute_ap(y, p), rel_tol=1e-9)
    pts = sorted((x["point"], x["fpr"], x["tpr"]) for x in M.roc_points(df, "y", "p").collect())
    want = _sk_roc(y, p)
    assert len(pts) == len(want)
    for (_, f, t), (wf, wt) in zip(pts, want):
        assert math.isclose(f, wf) and math.isclose(t, wt)


def test_calibration_bins_match_searchsorted(spark):
    vals = [0.0, 0.1, 0.10001, 0.3, 0.7, 1.0, 0.55, 0.95]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(vals)], "y int, p double")
    got = {r["bin"]: r["n"] for r in M.calibration_bins(df, "y", "p").collect()}
    edges = np.linspace(0.0, 1.0, 11)
    ids = np.searchsorted(edges[1:-1], np.array(vals))
    want = {int(b): int((ids == b).sum()) for b in set(ids)}
    assert got == want


def test_threshold_table_and_marketing_objective(spark):
    rng = random.Random(5)
    rows = [(0, rng.random() * 0.6) for _ in range(100)] + [(1, 0.2 + rng.random() * 0.7) for _ in range(20)]
    df = spark.createDataFrame(rows, "y int, p double")
    tt = M.threshold_table(df, "y", "p")
    assert tt.count() == 19
    assert tt.where(F.abs(F.col("threshold") - 0.5) < 1e-9).count() == 1
    f1 = M.operating_threshold(tt).first()
    f2 = M.operating_threshold(tt, marketing=True).first()
    assert f2["objective"] == "f2" and f1["objective"] == "f1"
    assert f2["threshold"] <= 0.5 and f2["recall"] >= f2["default_recall"]
    # counts equal the direct definition
    for r in tt.collect():
        t = r["threshold"]
        assert r["tp"] == sum(1 for y, p in rows if y == 1 and p >= t)
        assert r["fp"] == sum(1 for y, p in rows if y == 0 and p >= t)


def test_regression_and_forecast_metrics(spark):
    df = spark.createDataFrame(list(zip([100.0, 150.0, 200.0, 250.0, 300.0], [105.0, 145.0, 195.0, 260.0, 290.0])), "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert math.isclose(r["mae"], 7.0)
    assert r["r2"] > 0.95
    f = spark.createDataFrame(list(zip([50.0, 60.0, 70.0, 80.0], [48.0, 62.0, 71.0, 78.0])), "y double, p double")
    assert M.regression_metrics(f, "y", "p", forecast=True).first()["wape"] < 5


def test_registry_score_wape_forms(spark):
    df = spark.createDataFrame([("forecasting", {"wape": 18.13}), ("forecasting", {"wape": 0.1813}),
                                ("classification", {"roc_auc": 0.9911}), ("regression", {"r2": 1.7})],
                               "task string, m map<string,double>")
    name, score = M.registry_score(F.col("task"), F.col("m"))
    got = [r["s"] for r in df.select(score.alias("s")).collect()]
    assert got == [0.8187, 0.8187, 0.9911, 1.0]


def test_macro_roc_interpolation_matches_numpy(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        y = rng.randint(0, 2)
        raw = [rng.random() + (0.6 if c == y else 0.0) for c in range(3)]
        tot = sum(raw)
        for c in range(3):
            rows.append((i, y, c, round(raw[c] / tot, 2)))
    df = spark.createDataFrame(rows, "id long, y int, cls int, p double")
    got = {r["point"]: r["y"] for r in M.ovr_curves(df, "y", "cls", "p").where("curve = 'macro_roc'").collect()}
    grid = np.linspace(0, 1, 50)
    mean = np.zeros(50)
    for c in range(3):
        yy = [1 if r[1] == c else 0 for r in rows if r[2] == c]
        pp = [r[3] for r in rows if r[2] == c]
        order = sorted(set(pp), reverse=True)
        fps = [sum(1 for a, b in zip(pp, yy) if a >= t and b == 0) for t in order]
        tps = [sum(1 for a, b in zip(pp, yy) if a >= t and b == 1) for t in order]
        keep = [0] + [i for i in range(1, len(fps) - 1) if (fps[i + 1] - 2 * fps[i] + fps[i - 1]) != 0
                      or (tps[i + 1] - 2 * tps[i] + tps[i - 1]) != 0] + [len(fps) - 1]
        fpr = np.array([0] + [fps[i] for i in keep]) / fps[-1]
        tpr = np.array([0] + [tps[i] for i in keep]) / tps[-1]
        it = np.interp(grid, fpr, tpr)
        it[0] = 0.0
        mean += it
    mean /= 3
    mean[-1] = 1.0
    assert len(got) == 50
    for j in range(50):
        assert math.isclose(got[j], mean[j], rel_tol=1e-9, abs_tol=1e-12), j
