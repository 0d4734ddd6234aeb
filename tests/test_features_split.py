import math

import pandas as pd
from pyspark.sql import functions as F

from tabsight.operators import features, preprocess as PP, split as SP


def _series(spark, n=180):
    rows = [((pd.Timestamp("2023-01-01") + pd.Timedelta(days=i)).to_pydatetime(), float(100 + i + 10 * (i % 7))) for i in range(n)]
    return spark.createDataFrame(rows, "date timestamp, sales double"), rows


def test_block_halo_lags_equal_pandas(spark):
    df, rows = _series(spark)
    got = features.lag_features(df, "date", "sales", lags=[1, 2, 7], windows=[3, 7], block_rows=25,
                                max_series_rows=10).orderBy("date").toPandas()
    p = pd.DataFrame(rows, columns=["date", "sales"])
    for k in (1, 2, 7):
        p[f"target_lag_{k}"] = p["sales"].shift(k)
    for w in (3, 7):
        p[f"target_roll_mean_{w}"] = p["sales"].shift(1).rolling(w, min_periods=1).mean()
        p[f"target_roll_std_{w}"] = p["sales"].shift(1).rolling(w, min_periods=1).std().fillna(0)
    p = p.dropna(subset=["target_lag_1"]).reset_index(drop=True)
    assert len(got) == len(p) == 179
    for c in p.columns[2:]:
        a, b = got[c].tolist(), p[c].tolist()
        assert all((math.isnan(x) and math.isnan(y)) if (x != x or y != y) else math.isclose(x, y, rel_tol=1e-9)
                   for x, y in zip(a, b)), c
    assert int(got["cal_dayofweek"].iloc[0]) == pd.Timestamp("2023-01-02").dayofweek


def test_chronological_split_sizes(spark):
    df, _ = _series(spark)
    s = features.chronological_split(df, "date", "date", 0.2)
    tr = s.where(F.col("split") == "train")
    assert tr.count() == 144
    assert tr.agg(F.max("date")).first()[0] < s.where(F.col("split") == "test").agg(F.min("date")).first()[0]


def test_stratified_split_sizes_and_determinism(spark):
    rows = [(i, 1 if i % 5 == 0 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y int")
    a = SP.holdout_split(df, "id", "y", 0.25)
    counts = {(r["y"], r["split"]): r["n"] for r in a.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert counts[(1, "test")] == 10 and counts[(0, "test")] == 40
    assert a.where("split='test'").count() == 50
    b = SP.holdout_split(df.repartition(7), "id", "y", 0.25)
    assert sorted(r["id"] for r in a.where("split='test'").collect()) == sorted(r["id"] for r in b.where("split='test'").collect())


def test_fold_safe_scaling_ignores_validation(spark):
    tr = spark.createDataFrame([(0.0, "A"), (2.0, "A"), (4.0, "B")], "num double, cat string")
    va = spark.createDataFrame([(100.0, "A"), (1.0, "Z")], "num double, cat string")
    pp = PP.fit_preprocessor(tr, ["num"], ["cat"])
    out = pp.transform(va).collect()
    v = out[0]["features"].toArray()
    assert math.isclose(v[0], (100 - 2) / math.sqrt(8 / 3), rel_tol=1e-9)  # about 60.0
    assert list(out[1]["features"].toArray()[1:]) == [0.0, 0.0]  # unseen category -> all zeros


def test_hot_series_blocks_equal_plain_window(spark):
    df, rows = _series(spark, 120)
    multi = df.withColumn("s", F.lit("hot")).unionByName(
        df.where(F.col("sales") < 160).withColumn("s", F.lit("small")))
    a = features.lag_features(multi, "date", "sales", ["s"], lags=[1, 3], windows=[4], block_rows=16, max_series_rows=50)
    b = features.lag_features(multi, "date", "sales", ["s"], lags=[1, 3], windows=[4])
    cols = ["s", "date", "target_lag_1", "target_lag_3", "target_roll_mean_4", "target_roll_std_4"]
    ra = sorted(tuple(r) for r in a.select(*cols).collect())
    rb = sorted(tuple(r) for r in b.select(*cols).collect())
    assert len(ra) == len(rb)
    for x, y in zip(ra, rb):
        assert x[:2] == y[:2]
        assert all(math.isclose(u, v, rel_tol=1e-9) if u is not None else v is None for u, v in zip(x[2:], y[2:]))
