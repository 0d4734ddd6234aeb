import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabsight.operators import stats
from tabsight.operators.ordered import exact_quantiles


def _frame(spark):
    rng = random.Random(42)
    rows = []
    for i in range(200):
        age = None if i <= 30 else rng.randint(18, 80)
        rows.append((i, age, rng.gauss(50000, 15000), rng.choice(["a", "b", "c", "d"]), 1.0,
                     f"2023-01-{(i % 28) + 1:02d}", rng.choice([0, 1])))
    return spark.createDataFrame(rows, "row_id long, age int, income double, job_category string, "
                                       "constant_feature double, day string, target int")


def test_semantic_types_and_numeric_profile(spark):
    df = _frame(spark)
    cs = {r["column"]: r for r in stats.column_stats(df).collect()}
    assert cs["row_id"]["semantic_type"] == "id"
    assert cs["constant_feature"]["semantic_type"] == "constant"
    assert cs["day"]["semantic_type"] == "datetime"
    assert cs["job_category"]["semantic_type"] == "categorical"
    assert cs["income"]["semantic_type"] == "numeric"
    pdf = df.toPandas()
    s = pdf["income"].dropna()
    r = cs["income"]
    assert math.isclose(r["mean"], s.mean(), rel_tol=1e-12)
    assert math.isclose(r["std"], s.std(), rel_tol=1e-12)
    assert math.isclose(r["median"], s.median(), rel_tol=1e-12)
    assert math.isclose(r["q25"], s.quantile(0.25), rel_tol=1e-12)
    assert math.isclose(r["skewness"], s.skew(), rel_tol=1e-9)
    assert math.isclose(r["kurtosis"], s.kurt(), rel_tol=1e-9)
    assert cs["age"]["missing_count"] == 31
    assert math.isclose(cs["age"]["missing_pct"], 15.5)
    a = pdf["age"].dropna()
    assert math.isclose(cs["age"]["median"], a.median())


def test_date_detection_cases(spark):
    cases = {
        "iso": (["2023-01-01", "2023-02-15", "2023-03-30", "2023-04-01"], "datetime"),
        "us": (["01/15/2023", "02/20/2023", "12/31/2022", "07/04/2023"], "datetime"),
        "jobs": (["engineer", "teacher", "doctor", "nurse"], "categorical"),
        "status": (["active", "inactive", None, "active", "pending"], "categorical"),
    }
    for name, (vals, expected) in cases.items():
        df = spark.createDataFrame([(v,) for v in vals], "v string")
        cs = stats.column_stats(df, quantiles=False).first()
        assert cs["semantic_type"] == expected, name
    ints = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int")
    assert stats.column_stats(ints, quantiles=False).first()["semantic_type"] == "numeric"


def test_duplicates_treat_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x"), (2, "x"), (3, "y")], "a int, b string")
    r = stats.duplicate_rows(df).first()
    assert r["duplicate_rows"] == 3
    assert math.isclose(r["duplicate_pct"], 50.0)


def test_exact_quantiles_match_numpy_with_ties(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 20, 3000).astype(float), rng.normal(size=500)])
    groups = ["g1" if i % 3 else "g2" for i in range(len(vals))]
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(groups, vals)], "g string, v double")
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, ["g"], "v", probs, n_buckets=7).collect()}
    for g in ("g1", "g2"):
        arr = np.array([v for gg, v in zip(groups, vals) if gg == g])
        for p in probs:
            assert math.isclose(got[(g, p)], float(np.quantile(arr, p)), rel_tol=1e-12, abs_tol=1e-12)


def test_top_categories_tie_break(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    rows = stats.top_categories(df, 2).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in rows] == [("a", 2), ("b", 2)]


def test_date_shapes(spark):
    from pyspark.sql import functions as F
    from tabsight.functions import exprs as X
    shapes = {"2024-01-13T10:05:06Z": "2024-01-13T10:05:06", "2024-01-13 10:05:06.123": "2024-01-13T10:05:06", "2024.01.13": "2024-01-13T00:00:00",
              "13/12/2024": "2024-12-13T00:00:00", "12/13/2024": "2024-12-13T00:00:00", "January 13, 2024": "2024-01-13T00:00:00", "Jan 13 2024": "2024-01-13T00:00:00",
              "13-01-2024": "2024-01-13T00:00:00", "2024/1/3": "2024-01-03T00:00:00", "2024-01-13 10:05": "2024-01-13T10:05:00",
              "2024-01-13T10:05:06+02:00": "2024-01-13T08:05:06", "2024-02-31": None, "99/99/2024": None, "Foo 1 2024": None, "": None}
    df = spark.createDataFrame([(k,) for k in shapes], "s string").select("s", X.iso_format(X.parse_datetime(F.col("s"))).alias("d"))
    assert {r.s: r.d for r in df.collect()} == shapes


def test_an_empty_table_has_an_empty_profile(spark):
    from tabsight.operators import stats
    df = spark.createDataFrame([], "a int, b double, c string, d timestamp")
    rows = stats.column_stats(df).collect()
    assert len(rows) == 4 and all(r.missing_pct == 0 and r.n_distinct == 0 for r in rows)
    assert stats.missingness(df).count() == 5 and stats.duplicate_rows(df).first()["duplicate_pct"] == 0


def test_a_unique_date_named_like_an_id_is_the_time(spark):
    from tabsight.operators import classify
    df = spark.range(60).selectExpr("date_format(date '2024-01-01' + cast(id as int), 'yyyy-MM-dd') as paid_date", "cast(id * 3 % 17 as double) as sales")
    r = classify.decide_task(df, goal="forecast sales").first()
    assert (r.problem_type, r.time_column, r.target_column) == ("forecasting", "paid_date", "sales")


def test_duplicate_rows_tell_null_places_apart(spark):
    from tabsight.operators import stats
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), ("a", "b")], "x string, y string")
    assert stats.duplicate_rows(df).first()["duplicate_rows"] == 1
