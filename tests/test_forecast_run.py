import random

import pytest
from pyspark.sql import functions as F

from tabsight.operators import features, models
from tabsight.plans import analysis


def _days(spark, n=150, stores=(None,)):
    rng = random.Random(4)
    rows = [(s, i, 100.0 + 20 * (i % 7) + rng.random(), rng.choice(["a", "b"])) for s in stores for i in range(n)]
    df = spark.createDataFrame(rows, "store string, i int, sales double, promo string")
    return df.withColumn("day", F.date_format(F.expr("date '2024-01-01' + i"), "MM/dd/yyyy")).drop("i")


def test_forecasting_run_on_text_dates(spark):
    r = analysis.run_analysis(spark, _days(spark).drop("store"), "forecast sales", "sales", "day", candidates=["Ridge", "Seasonal_Naive", "Baseline"])
    assert r.task["problem_type"] == "forecasting" and r.extra["validation"] == "walk_forward_time_split" and r.extra["folds"] == 3
    scores = {x["model_name"]: x["cv_mean"] for x in r.experiments.collect()}
    assert set(scores) == {"Ridge", "Seasonal_Naive", "Baseline"}
    assert scores["Seasonal_Naive"] < 2 < scores["Baseline"]
    assert r.champion in ("Seasonal_Naive", "Ridge")


def test_series_need_keys_and_do_not_mix(spark):
    df = _days(spark, 60, ("x", "y")).withColumn("sales", F.when(F.col("store") == "x", 1.0).otherwise(100.0))
    with pytest.raises(ValueError, match="group_cols"):
        analysis.run_analysis(spark, df, "forecast sales", "sales", "day", candidates=["Baseline"])
    t = df.withColumn("day", F.to_date("day", "MM/dd/yyyy"))
    lags = features.lag_features(t, "day", "sales", ["store"], lags=[1], windows=[2])
    assert lags.where("target_lag_1 <> sales").count() == 0


def test_expanding_folds_never_train_on_later_times(spark):
    df = _days(spark, 40, ("x", "y")).withColumn("day", F.to_date("day", "MM/dd/yyyy"))
    folds = features.walk_forward_folds(df, "day", 3)
    spans = folds.groupBy("fold", "role").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("*").alias("n")).collect()
    at = {(r.fold, r.role): r for r in spans}
    for f in (1, 2, 3):
        assert at[(f, "train")].hi < at[(f, "validation")].lo and at[(f, "validation")].n == 20


def test_multiclass_fold_score_is_the_macro_auc(spark):
    rows = [(k % 2, float(k % 3), 0.0, [0.6, 0.3, 0.1] if k % 3 == 0 else [0.2, 0.5, 0.3] if k % 3 == 1 else [0.1, 0.2, 0.7]) for k in range(60)]
    pred = spark.createDataFrame(rows, "fold int, label double, prediction double, probs array<double>")
    got = {r.fold: r.score for r in models._fold_score("classification", pred, 3).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(1.0)
