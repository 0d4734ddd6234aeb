"""Tree attributions (I2): path-dependent Shapley values of tree ensembles.

A forest is a table of nodes (tree, node, children, split, cover, values).  Each leaf is reduced to the conditions that its path
puts on every feature it tests: an interval, or a set of categories, and the share ``z`` of the training rows
that would take the path if the feature were unknown.  For one row, ``o`` is 1 where the row meets the condition.  A leaf's
part in the attribution of feature f is

    value * (o_f - z_f) * integral over t in (0, 1) of the product of z_j (1 - t) + o_j t over the other features,

because the integral of t^k (1 - t)^(d - 1 - k) is the weight k! (d - 1 - k)! / d! of a coalition of k features.  The integrand
is a polynomial, so Gauss-Legendre quadrature with half as many points as features gives it exactly; all rows, leaves and
points of a batch are one numpy product.  Attributions of a row add up to its prediction minus the forest's mean.

Scale: rows are scored in Arrow batches, all of them.  The forest is sent to the tasks in pieces of at most ``MAX_NODES``
nodes, whose parts add up, so its size doesn't matter to one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.session import checkpoint_dir

FOREST = "tree int, node int, left int, right int, feature int, threshold double, categories array<double>, arity int, cover double, values array<double>"
#: Nodes of the forest that a task holds at once.
MAX_NODES = 400_000
#: Rows times leaves times features that are worked on at once.
CELLS = 2_000_000


def forest_table(model, spark: SparkSession) -> DataFrame:
    """The nodes of a fitted Spark ML tree ensemble (or tree).

    Values are class probabilities of each tree over the number of trees (random forests, trees), weighted predictions
    (regression boosting) or weighted log-odds (binary boosting, where the margin counts twice)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    kind = type(model).__name__
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
        weights = list(model.treeWeights)
    else:
        data, weights = data.withColumn("tree", F.lit(0)), [1.0]
    share = 1.0 if kind.startswith("GBT") or len(weights) == 1 else 1.0 / len(weights)
    factor = {"GBTClassificationModel": 2.0}.get(kind, 1.0)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in (weights if kind.startswith("GBT") else [1.0] * len(weights))]), F.col("tree") + 1) * share * factor
    total = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    if kind.endswith("ClassificationModel") and not kind.startswith("GBT"):
        cover, values = total, F.transform("impurityStats", lambda x: x / total * weight)
    else:
        cover, values = F.get("impurityStats", 0), F.array(F.col("prediction") * weight)
    split = F.col("split")
    numeric = split["numCategories"] == -1
    return data.select(
        "tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), split["featureIndex"].alias("feature"),
        F.when(numeric, F.get(split["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        F.when(~numeric, split["leftCategoriesOrThreshold"]).alias("categories"), split["numCategories"].alias("arity"), cover.alias("cover"), values.alias("values"))


class Leaves:
    """The leaves of some trees: per leaf and tested feature the condition and the share of rows without it."""

    def __init__(self, nodes: pd.DataFrame):
        rows = []
        for _, tree in nodes.groupby("tree"):
            by = {n.node: n for n in tree.itertuples(index=False)}
            todo = [(by[0], {})]
            while todo:
                n, path = todo.pop()
                if n.left < 0:
                    rows.append((path, np.asarray(n.values, dtype=float)))
                    continue
                for child, goes_left in ((by[n.left], True), (by[n.right], False)):
                    share = child.cover / n.cover if n.cover else 0.0
                    low, high, allowed, z = path.get(n.feature, (-np.inf, np.inf, None, 1.0))
                    if n.categories is not None:
                        left = frozenset(int(c) for c in n.categories)
                        here = left if goes_left else frozenset(range(int(n.arity))) - left
                        allowed = here if allowed is None else allowed & here
                    elif goes_left:
                        high = min(high, n.threshold)
                    else:
                        low = max(low, n.threshold)
                    todo.append((child, {**path, n.feature: (low, high, allowed, z * share)}))
        self.width = max([1, *(len(p) for p, _ in rows)])
        shape = (len(rows), self.width)
        self.feature, self.low, self.high = np.zeros(shape, dtype=np.int64), np.full(shape, -np.inf), np.full(shape, np.inf)
        self.z, self.used = np.ones(shape), np.zeros(shape, dtype=bool)
        self.sets: list[tuple[int, int, np.ndarray]] = []
        self.values = np.array([v for _, v in rows]) if rows else np.zeros((0, 1))
        for i, (path, _) in enumerate(rows):
            for j, (f, (low, high, allowed, z)) in enumerate(path.items()):
                self.feature[i, j], self.low[i, j], self.high[i, j], self.z[i, j], self.used[i, j] = f, low, high, z, True
                if allowed is not None:
                    self.sets.append((i, j, np.array(sorted(allowed), dtype=float)))
        x, w = np.polynomial.legendre.leggauss(max(1, -(-self.width // 2)))
        self.points, self.weights = (x + 1) / 2, w / 2
        #: what a row of which nothing is known is expected to get
        self.mean = (self.z.prod(axis=1)[:, None] * self.values).sum(axis=0)

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes, features)"""
        n, k = x.shape
        out = np.zeros((n, self.values.shape[1], k))
        step = max(1, CELLS // max(1, self.z.size))
        spread = np.zeros((self.z.size, k))
        spread[np.arange(self.z.size), self.feature.ravel()] = self.used.ravel()
        for a in range(0, n, step):
            part = x[a:a + step][:, self.feature]
            met = ~(part <= self.low) & ((part <= self.high) | np.isinf(self.high))
            for i, j, allowed in self.sets:
                met[:, i, j] &= np.isin(part[:, i, j], allowed)
            o = np.where(self.used, met, 1.0)
            share = np.zeros_like(o)
            for t, w in zip(self.points, self.weights, strict=True):
                factors = self.z * (1 - t) + o * t
                share += w * factors.prod(axis=2, keepdims=True) / factors
            share *= o - self.z
            for c in range(self.values.shape[1]):
                out[a:a + step, c] = (share * self.values[:, c][:, None]).reshape(len(part), -1) @ spread
        return out


def tree_shap(rows: DataFrame, forest: DataFrame, n_features: int, features: str = "x", max_nodes: int = MAX_NODES) -> DataFrame:
    """``rows`` with ``shap`` (per class an array with one attribution per feature) and ``shap_mean`` (per class).

    ``features``: an array of doubles.  An unknown split value (NaN) takes the right branch, as in Spark's trees."""
    # trees are dealt out to pieces by their running size; the table has one row per tree
    sizes = sorted((r["tree"], r["n"]) for r in forest.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect())
    pieces, held = [[]], 0
    for tree, n in sizes:
        if pieces[-1] and held + n > max_nodes:
            pieces.append([])
            held = 0
        pieces[-1].append(tree)
        held += n
    keep = rows.columns
    zero = F.array().cast("array<array<double>>")
    out = rows.withColumns({"shap": zero, "shap_mean": F.array().cast("array<double>")})
    for piece in pieces:
        nodes = forest.where(F.col("tree").isin(piece)).toPandas()
        out = out.mapInPandas(_adder(nodes, features, n_features), out.schema)
    return out.select(*keep, "shap", "shap_mean")


def _adder(nodes: pd.DataFrame, features: str, n_features: int):
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = Leaves(nodes)
        for b in batches:
            if not len(b):
                yield b
                continue
            x = np.array([np.asarray(v, dtype=float) for v in b[features]]).reshape(len(b), n_features)
            got = leaves.attributions(x)
            yield b.assign(
                shap=[[list(row) for row in (g if not len(old) else g + np.array([list(o) for o in old]))] for g, old in zip(got, b["shap"])],
                shap_mean=[list(leaves.mean if not len(old) else leaves.mean + np.asarray(old)) for old in b["shap_mean"]])
    return add


def mean_abs(explained: DataFrame, names: list[str], class_id: int | None = None) -> DataFrame:
    """Mean |attribution| per feature over all rows: of one class, or the mean over classes."""
    per = explained.select(F.posexplode("shap").alias("class", "s")).select("class", F.posexplode("s").alias("j", "v"))
    if class_id is not None:
        per = per.where(F.col("class") == class_id)
    by = per.groupBy("class", "j").agg(F.avg(F.abs("v")).alias("m")).groupBy("j").agg(F.avg("m").alias("mean_abs_shap"))
    return by.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1).alias("feature"), "mean_abs_shap")


def explain_model(feats: DataFrame, model, names: list[str], class_id: int | None = None, features_col: str = "features") -> DataFrame:
    """Mean |attribution| per feature of a fitted Spark ML tree model over all rows of ``feats``."""
    rows = feats.select(vector_to_array(features_col).alias("x"))
    return mean_abs(tree_shap(rows, forest_table(model, feats.sparkSession), len(names)), names, class_id)
