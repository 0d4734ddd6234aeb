import random

from pyspark.sql import functions as F

from tabsight.operators import features, quality


def _bike(spark):
    rng = random.Random(42)
    rows = []
    for i in range(200):
        casual, registered = rng.randint(0, 50), rng.randint(10, 300)
        rows.append((f"2012-01-{(i // 24) + 1:02d} {i % 24:02d}:00:00", rng.random(), rng.random(), rng.random(),
                     casual, registered, casual + registered))
    return spark.createDataFrame(rows, "dteday string, temp double, hum double, windspeed double, casual int, "
                                       "registered int, cnt int")


def test_additive_leak_found_exactly(spark):
    lk = {r["column"] for r in quality.leakage_columns(_bike(spark), "cnt").collect()}
    assert lk == {"casual", "registered"}


def test_lag_and_calendar_features_not_flagged(spark):
    df = _bike(spark).withColumn("ts", F.to_timestamp("dteday"))
    f = features.lag_features(df.drop("casual", "registered"), "ts", "cnt", lags=[1, 2], windows=[3])
    lk = {r["column"] for r in quality.leakage_columns(f.drop("dteday"), "cnt").collect()}
    assert not any(c.startswith(("target_lag_", "target_roll_", "cal_")) for c in lk)


def test_pair_screen_is_exact(spark, monkeypatch):
    df = _bike(spark).withColumn("mostly", F.when(F.col("casual") == 50, 7).otherwise(F.col("cnt") - F.col("registered"))) \
        .withColumn("gross", F.col("cnt") + F.col("temp")).withColumn("holes", F.when(F.col("casual") > 3, F.col("cnt") - F.col("hum")))
    full = sorted(map(repr, quality.leakage_findings(df, "cnt").collect()))  # the sample is the table
    assert any("gross" in r and "difference" in r for r in full) and any("holes" in r and "additive" in r for r in full)
    monkeypatch.setattr(quality, "SCREEN_ROWS", 60)
    assert sorted(map(repr, quality.leakage_findings(df, "cnt").collect())) == full
    monkeypatch.setattr(quality, "_possible_pairs", lambda own, target, cols, n: {p[:3] for p in quality._pair_exprs(cols, target)})
    assert sorted(map(repr, quality.leakage_findings(df, "cnt").collect())) == full


def test_alerts_on_flawed_frame(spark):
    rng = random.Random(1)
    rows = [(None if i <= 30 else rng.randint(18, 80), rng.random(), 1.0, rng.choice([0, 0, 0, 0, 1])) for i in range(200)]
    df = spark.createDataFrame(rows, "age int, income double, constant_feature double, target int")
    types = {(r["alert_type"], r["column"]) for r in quality.quality_alerts(df, "target").collect()}
    assert ("moderate_missingness", "age") in types
    assert ("constant_feature", "constant_feature") in types
