import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tabsight.operators import forest, models


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(1)
    n = 6000
    x = np.column_stack([draw.integers(0, 2, n), draw.integers(1, 8, n), draw.normal(size=n), draw.random(n).round(2), np.ones(n)])
    y = x[:, 1] * 1000 * (1 + x[:, 2] * 0.2) + 300 * x[:, 0] - 500 * x[:, 3] + draw.normal(size=n) * 200
    both = spark.createDataFrame([(i, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["i", "features", "label"])
    return x, y, both.cache()


def test_a_tree_over_all_rows_is_sparks(spark, rows):
    x, y, both = rows
    splits = [forest.thresholds(c) for c in x.T]
    bins = np.stack([np.searchsorted(s, c) for s, c in zip(splits, x.T)], 1).astype(np.uint8)
    nodes = forest.grow(bins, np.stack([np.ones(len(y)), y, y * y], 1), splits, 6, 5, np.random.default_rng(0))
    other = DecisionTreeRegressor(maxDepth=6, seed=1).fit(both)

    def predicted(v):
        at = nodes[0]
        while at["leftChild"] >= 0:
            at = nodes[at["leftChild" if v[at["feature"]] <= at["threshold"] else "rightChild"]]
        return at["prediction"]
    want = [r["prediction"] for r in other.transform(both).orderBy("i").collect()]
    assert len(nodes) == other.numNodes and np.allclose([predicted(v) for v in x], want)


@pytest.mark.parametrize("task_rows", [500, 500_000])
def test_forest_is_as_good_as_sparks(spark, rows, task_rows, monkeypatch):
    both = rows[2]
    monkeypatch.setattr(forest, "ROWS_PER_TASK", task_rows)
    train, test = both.where("i % 4 <> 0"), both.where("i % 4 = 0")
    rmse = lambda m: m.transform(test).agg(F.sqrt(F.avg((F.col("prediction") - F.col("label")) ** 2))).first()[0]
    own = forest.fit(train, train.count(), 40, 8, 7)
    theirs = RandomForestRegressor(numTrees=40, maxDepth=8, seed=7).fit(train)
    assert rmse(own) < 1.1 * rmse(theirs) and own.getNumTrees == 40 and own.numFeatures == 5
    assert np.abs(own.featureImportances.toArray() - theirs.featureImportances.toArray()).max() < 0.05
    assert len({t.toDebugString.split("\n", 1)[1] for t in own.trees}) == 40
    again = forest.fit(train, train.count(), 40, 8, 7)
    assert again.toDebugString.split("\n", 1)[1] == own.toDebugString.split("\n", 1)[1]


def test_portfolio_counts_equal_rows_together(spark, rows, monkeypatch):
    """The portfolio's regression forest reads the rows in passes whose number doesn't grow with the depth; many codes are Spark's."""
    both, made = rows[2], []
    fit = forest.fit
    monkeypatch.setattr(forest, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    monkeypatch.setitem(models.PRESETS, "random_forest", {"numTrees": 5, "maxDepth": 4})
    assert models.fit_model("random_forest", "regression", both, 0).stages[0] is made[0]
    monkeypatch.setattr(forest, "CODES", 3)
    m = models.fit_model("random_forest", "regression", both, 0)
    assert made[1] is None and m.stages[0].getNumTrees == 5
