import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import critic, evidence, explain, models, preprocess as PP, split as SP


def test_model_aliases_and_unknown():
    assert models.resolve_model("LightGBM", "classification")[0] == "gbt_lgbm"
    assert models.resolve_model("random_forest", "regression")[1] == "random_forest"
    assert models.resolve_model("LogisticRegression_LeakFree", "classification")[0] == "logistic"
    assert models.resolve_model("Ridge", "forecasting")[0] == "ridge"
    with pytest.raises(ValueError):
        models.resolve_model("Prophet", "regression")
    with pytest.raises(ValueError):
        models.resolve_model("Ridge", "eda")


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 3)) * [1.0, 5.0, 0.2] + [3.0, -2.0, 0.0]
    y = X @ np.array([2.0, -1.0, 4.0]) + 1.5 + rng.normal(scale=0.5, size=300)
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.dense(x), float(t)) for x, t in zip(X, y)], ["features", "label"])
    fm = models.fit_model("ridge", "regression", df, 0)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 1.0 * np.eye(3), Xc.T @ yc)
    got = fm.stages[0].coefficients.toArray()
    assert np.allclose(got, w, rtol=1e-4, atol=1e-5)


def _exp_frame(spark, rows):
    schema = ("experiment_id string, model_name string, problem_type string, validation_strategy string, "
              "target_column string, cv_mean double, cv_rmse double, train map<string,double>, test map<string,double>, "
              "feature_names array<string>, raw_columns array<string>, remediated array<string>")
    return spark.createDataFrame(rows, schema)


def test_critic_cases(spark):
    rows = [
        ("leak", "LightGBM", "classification", "stratified_kfold", "y", 0.95, None, {"roc_auc": 0.95}, {},
         ["age", "duration", "job"], ["age", "duration", "job", "y"], []),
        ("overfit", "RandomForest", "classification", "stratified_kfold", "y", 0.0, None, {"roc_auc": 0.999},
         {"roc_auc": 0.650}, ["a"], ["a", "y"], []),
        ("clean", "Ridge", "regression", "kfold", "cnt", 1.0, 1.0, {"rmse": 1.0}, {}, ["temp"],
         ["temp", "casual", "cnt"], ["casual", "registered"]),
        ("ts", "LightGBM", "forecasting", "kfold", "sales", 5.0, None, {"rmse": 2.0}, {}, ["lag_1"], ["sales"], []),
    ]
    e = _exp_frame(spark, rows)
    f = critic.critique(e)
    st = {r["experiment_id"]: r for r in critic.audit_status(e, f).collect()}
    issues = {(r["experiment_id"], r["issue_type"]) for r in f.collect()}
    assert ("leak", "domain_target_leakage") in issues
    assert st["leak"]["audit_status"] == "CRITICAL_ISSUES_FOUND" and "REMOVE_LEAKY_FEATURES" in st["leak"]["actions"]
    assert ("overfit", "severe_overfitting") in issues
    assert st["clean"]["audit_status"] == "PASSED (Remediated)"
    assert ("ts", "improper_validation") in issues


def test_champion_by_cv_not_holdout(spark):
    rows = [("a", "A", "linear", "classification", 0.81, 0.99), ("b", "B", "random_forest", "classification", 0.86, 0.70),
            ("c", "C", "linear", "regression", 16.62, 1.0), ("d", "D", "baseline", "regression", 75.03, 0.0)]
    df = spark.createDataFrame(rows, "experiment_id string, model_name string, model_family string, task_type string, "
                                     "cv_mean double, holdout double")
    lb = {r["model_name"]: r for r in evidence.leaderboard(df, group_cols=["task_type"]).collect()}
    assert lb["B"]["is_champion"] and not lb["A"]["is_champion"]
    assert lb["C"]["is_champion"]


def test_threshold_locked_before_holdout(spark):
    rng = random.Random(0)
    rows = [(i, rng.random(), rng.choice(["x", "y"]), 1 if rng.random() < 0.3 else 0) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, f double, c string, label int").withColumn("label", F.col("label").cast("double"))
    sp = SP.holdout_split(df, "id", "label", 0.2)
    tr, te = sp.where("split='train'").drop("split"), sp.where("split='test'").drop("split")
    cv = models.prepare_cv(tr, "id", ["f"], ["c"], "classification", 3)
    e = models.train_candidate("LogisticRegression", "classification", cv, 2, ["0", "1"])
    t = e.threshold
    assert t is not None
    # flipping the holdout labels cannot move a threshold chosen on out-of-fold rows
    d1, l1, _ = models.evaluate_holdout(e, te, "id")
    d2, l2, _ = models.evaluate_holdout(e, te.withColumn("label", 1 - F.col("label")), "id")
    assert l1["threshold"] == l2["threshold"] == t
    assert e.oof.count() == tr.count()


def test_shap_reduction(spark):
    two = spark.createDataFrame([(0, 0, "f0", 1.0), (1, 0, "f0", -1.0), (0, 0, "f1", 2.0), (1, 0, "f1", 2.0),
                                 (0, 0, "f2", -3.0), (1, 0, "f2", 3.0)], "row int, class int, feature string, value double")
    got = {r["feature"]: r["mean_abs_shap"] for r in explain.reduce_shap(two).collect()}
    assert got == {"f0": 1.0, "f1": 2.0, "f2": 3.0}


def test_metrics_scan_written_predictions(spark):
    """A scan of predictions reads what was written; the model doesn't score the rows again."""
    from pyspark.ml.feature import VectorAssembler
    from tabsight.operators import models
    rows = spark.range(40).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("label"))
    feats = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows).select("k", "label", "features")
    model = models.fit_model("random_forest", "regression", feats, 0)
    pred = models.predictions(model, feats)
    assert "UDF" not in pred._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" in model.predict(feats)._jdf.queryExecution().optimizedPlan().toString()
    assert pred.orderBy("k").select("k", "prediction").collect() == model.predict(feats).orderBy("k").select("k", "prediction").collect()
