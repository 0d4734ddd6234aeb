"""Tree attributions: against subset enumeration, and added up against the models' own predictions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsight.operators import models, treeshap


def by_subsets(nodes, x, n_features):
    """Shapley values of the path-dependent expectation, by all coalitions."""
    out = np.zeros((len(nodes.iloc[0]["values"]), n_features))
    for _, tree in nodes.groupby("tree"):
        by = {n.node: n for n in tree.itertuples(index=False)}

        def expected(i, known):
            n = by[i]
            if n.left < 0:
                return np.asarray(n.values)
            a, b = by[n.left], by[n.right]
            if n.feature in known:
                left = x[n.feature] in set(n.categories) if n.categories is not None else x[n.feature] <= n.threshold
                return expected(n.left if left else n.right, known)
            return (a.cover * expected(n.left, known) + b.cover * expected(n.right, known)) / n.cover
        for f in range(n_features):
            others = [j for j in range(n_features) if j != f]
            for k in range(n_features):
                for s in itertools.combinations(others, k):
                    w = math.factorial(k) * math.factorial(n_features - 1 - k) / math.factorial(n_features)
                    out[:, f] += w * (expected(0, {*s, f}) - expected(0, set(s)))
    return out


def random_forest(draw, n_trees, depth, n_features, classes):
    rows = []
    for tree in range(n_trees):
        todo, count = [(0, 100.0, 0)], 1
        while todo:
            node, cover, d = todo.pop()
            values = [float(v) for v in draw.normal(size=classes)]
            if d == depth or draw.random() < 0.15:
                rows.append((tree, node, -1, -1, -1, None, None, -1, cover, values))
                continue
            f, share = int(draw.integers(n_features)), float(draw.uniform(0.05, 0.95))
            cats = [float(c) for c in draw.permutation(3)[:draw.integers(1, 3)]] if f == 0 else None
            rows.append((tree, node, count, count + 1, f, None if cats else float(draw.normal()), cats, 3 if cats else -1, cover, values))
            todo += [(count, cover * share, d + 1), (count + 1, cover * (1 - share), d + 1)]
            count += 2
    return pd.DataFrame(rows, columns=["tree", "node", "left", "right", "feature", "threshold", "categories", "arity", "cover", "values"])


@pytest.mark.parametrize("classes, depth", [(1, 1), (1, 5), (3, 4), (1, 0)])
def test_against_all_coalitions(classes, depth):
    draw = np.random.default_rng(depth)
    nodes = random_forest(draw, 3, depth, 5, classes)
    x = draw.normal(size=(6, 5))
    x[:, 0] = draw.integers(0, 3, 6)
    x[0, 1] = np.nan
    got = treeshap.Leaves(nodes).attributions(x)
    for i in range(1, 6):
        assert np.allclose(got[i], by_subsets(nodes, x[i], 5), atol=1e-12)
    assert np.isfinite(got).all()


def _frame(spark, classes):
    from pyspark.ml.feature import VectorAssembler
    draw = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        a, b, c = draw.normal(size=3)
        rows.append((float(a), float(b), float(c), float(int(a + b > 0) + (int(c > 0.5) if classes == 3 else 0)), float(3 * a - b * c)))
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, y double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


@pytest.mark.parametrize("kind", ["rf2", "rf3", "rf_regression", "gbt", "gbt_regression", "tree"])
def test_attributions_add_up_to_the_prediction(spark, kind):
    from pyspark.ml import classification as C, regression as R
    df = _frame(spark, 3 if kind == "rf3" else 2)
    if "regression" in kind:
        df = df.withColumn("label", F.col("y"))
    est = {"rf2": C.RandomForestClassifier(numTrees=7, maxDepth=4, seed=1), "rf3": C.RandomForestClassifier(numTrees=5, maxDepth=5, seed=1),
           "rf_regression": R.RandomForestRegressor(numTrees=6, maxDepth=5, seed=1), "gbt": C.GBTClassifier(maxIter=6, maxDepth=3, seed=1),
           "gbt_regression": R.GBTRegressor(maxIter=6, maxDepth=3, seed=1), "tree": C.DecisionTreeClassifier(maxDepth=4)}[kind]
    model = est.fit(df)
    pred = model.transform(df)
    forest = treeshap.forest_table(model, spark)
    n_nodes = forest.count()
    for max_nodes in (10**6, max(20, n_nodes // 3)):
        own = treeshap.tree_shap(pred.select(vector_to_array("features").alias("x"), *[c for c in ("probability", "prediction", "rawPrediction") if c in pred.columns]), forest, 3, max_nodes=max_nodes)
        for r in own.collect():
            total = np.array(r["shap"]).sum(axis=1) + np.array(r["shap_mean"])
            want = [r["prediction"]] if "regression" in kind else [2 * r["rawPrediction"][1]] if kind == "gbt" else r["probability"].toArray()
            assert np.allclose(total, want, atol=1e-9)


def test_mean_attributions_name_the_drivers(spark):
    df = _frame(spark, 2)
    m = models.fit_model("random_forest", "classification", df, 2)
    got = {r["feature"]: r["mean_abs_shap"] for r in treeshap.explain_model(df, m.stages[0], ["a", "b", "c"], class_id=1).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] < got["a"] / 2 and got["c"] < got["b"] / 2


@pytest.mark.parametrize("preset", ["random_forest", "logistic", "baseline"])
def test_importance_of_a_champion(spark, preset):
    from types import SimpleNamespace

    from tabsight.operators import explain
    df = _frame(spark, 2)
    model = models.fit_model(preset, "classification", df, 2)
    exp = SimpleNamespace(preprocessor=SimpleNamespace(feature_names=["a", "b", "c"]), model=model, n_classes=2, preset=preset)
    got = {r["feature"]: r["mean_abs_shap"] for r in explain.shap_importance(spark, exp, df).collect()}
    assert set(got) == {"a", "b", "c"}
    assert all(v == 0 for v in got.values()) if preset == "baseline" else got["c"] < got["a"]
