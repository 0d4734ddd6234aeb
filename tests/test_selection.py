"""Quantiles by selection against numpy, on sketches' own ground and with a sketch that breaks its promise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.operators import ordered, stats


def _frame(spark, n):
    draw = np.random.default_rng(n)
    rows = [(float(a), float(b), None if i % 3 else float(c), float(i % 2)) for i, (a, b, c) in enumerate(zip(draw.normal(size=n), draw.integers(0, 7, n), draw.exponential(size=n)))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)


@pytest.mark.parametrize("n, small", [(1, None), (2, None), (7, None), (4000, None), (4000, 10), (40, 3)])
def test_quantiles_of_columns(spark, monkeypatch, n, small):
    if small is not None:
        monkeypatch.setattr(ordered, "SMALL_GROUP", small)
    df = _frame(spark, n)
    if small == 10:
        monkeypatch.setattr(ordered, "ACCURACY", 100)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = ordered.column_quantiles(df, {c: F.col(c) for c in "abcd"}, probs)
    data = df.toPandas()
    for c in "abcd":
        own = data[c].dropna()
        if not len(own):
            assert c not in got
            continue
        assert [got[c][p] for p in probs] == pytest.approx([own.quantile(p) for p in probs])


def test_a_wrong_sketch_is_noticed(spark):
    df = _frame(spark, 500)
    wrong = {"a": {"n": 500, "min": -9.0, "max": 9.0, "marks": [2.0, 2.5]}}
    ordered_small = ordered.SMALL_GROUP
    ordered.SMALL_GROUP = 0
    try:
        got = ordered.column_quantiles(df, {"a": F.col("a")}, [0.5], wrong)
    finally:
        ordered.SMALL_GROUP = ordered_small
    assert got["a"][0.5] == pytest.approx(df.toPandas()["a"].median())


def test_numeric_profile_of_odd_tables(spark):
    none = spark.createDataFrame([], "x double, id long")
    assert stats.numeric_profile(none).count() == 0
    assert stats.numeric_profile(spark.createDataFrame([("t",)], "s string")).count() == 0
    df = spark.range(100).select(F.col("id").alias("row_id"), F.lit(3.0).alias("same"), (F.col("id") % 10).cast("double").alias("v"), F.lit(None).cast("double").alias("none"), (F.col("id") % 40).alias("group_id"))
    assert {r["column"] for r in stats.numeric_profile(df).collect()} == {"v", "group_id"}
