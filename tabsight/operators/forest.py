"""Regression forests over binned rows (M3): Spark ML's random forest with its rows counted together where the learner can't tell them apart.

Spark's learner bins every feature (``BINS`` at most) and then reads all rows once a level for each of its trees. Here the bins of a row
are one code. The rows of a code differ in their labels and their bootstrap weights only, so a tree needs three sums of each code:
weights, weighted labels, weighted squares. One pass over the rows draws a Poisson weight of every row for every tree and adds these
up; each tree is then grown in one task from the sums, which are the histograms that Spark would build at every level. Bins, bootstrap, features drawn for
a node (a third), impurity (variance), gain and stopping rules are Spark's; only the random draws are others. The result is a
``RandomForestRegressionModel``.

Scale: rows are dealt by code, those of a frequent code over several tasks. A tree's task holds 32 bytes and
the bins of each code. Tables with more than ``CODES`` codes, whose sums would not fit one task, and those with too many
features for a code are left to Spark's learner (``fit`` gives None).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from tabsight.session import checkpoint_dir, cut_lineage

#: Spark's maxBins, and the rows that it looks at to find them.
BINS, SAMPLE = 32, 10_000
#: Codes whose sums a task holds at most.
CODES = 200_000
#: Rows that a task weighs.
ROWS_PER_TASK = 500_000
_EPSILON = 2.0 ** -52
_SUMS = "tree int, part int, codes binary, w binary, s binary, q binary"
_NODES = ("treeID int, id int, prediction double, impurity double, w double, s double, q double, gain double, leftChild int, "
          "rightChild int, feature int, threshold double")


def thresholds(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Spark's splits of a feature: between all values if they are few, else between values about as many rows apart."""
    v, counts = np.unique(values, return_counts=True)
    if len(v) <= bins:
        return (v[:-1] + v[1:]) / 2.0
    stride, out = len(values) / bins, []
    target, have = stride, counts[0]
    for i in range(1, len(v)):
        before, have = have, have + counts[i]
        if abs(before - target) < abs(have - target):
            out.append((v[i - 1] + v[i]) / 2.0)
            target += stride
    return np.array(out)


def _coder(splits: list[np.ndarray], strides: list[int]):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            c = np.zeros(b.num_rows, dtype=np.int64)
            for j, (s, stride) in enumerate(zip(splits, strides, strict=True)):
                c += np.searchsorted(s, x[:, j]) * stride
            yield pa.record_batch({"code": pa.array(c), "y": b["y"]})
    return code


def _weigher(trees: int, seed: int):
    """For each tree the sums of each code, with a Poisson weight for each row."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held = [(b["code"].to_numpy(), b["y"].to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        code, y = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((y, code))
        code, y = code[order], y[order]
        start = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        part = TaskContext.get().partitionId()
        own = code[start]
        for t in range(trees):
            w = np.random.default_rng([seed, t, part]).poisson(1.0, len(y)).astype(np.float64)
            wy = w * y
            sums = np.add.reduceat(w, start), np.add.reduceat(wy, start), np.add.reduceat(wy * y, start)
            some = sums[0] > 0
            yield pa.record_batch({"tree": pa.array([t], pa.int32()), "part": pa.array([part], pa.int32()), "codes": pa.array([own[some].tobytes()], pa.binary()),
                                   **{k: pa.array([v[some].tobytes()], pa.binary()) for k, v in zip("wsq", sums, strict=True)}})
    return weigh


def grow(bins: np.ndarray, sums: np.ndarray, splits: list[np.ndarray], depth: int, per_node: int, draw: np.random.Generator) -> list[dict]:
    """The nodes of one tree, parents first and left before right. ``bins``: codes by features; ``sums``: weight, weighted label and
    weighted square of each code; ``per_node``: features that a node may split on."""
    def variance(w, s, q):
        w1 = np.maximum(w, 1.0)  # weights are whole
        return np.where(w > 0, (q - s * s / w1) / w1, 0.0)
    total = sums.sum(0)
    tree = [{"stats": total, "impurity": float(variance(*total))}]
    at = np.zeros(len(bins), dtype=np.int64)  # place in ``live`` of each code's node
    rows = np.arange(len(bins))
    live = [0] if tree[0]["impurity"] >= _EPSILON else []
    for _ in range(depth if len(splits) else 0):
        if not live:
            break
        k = len(live)
        stats = np.array([tree[i]["stats"] for i in live])
        chosen = np.zeros((k, len(splits)), dtype=bool)
        np.put_along_axis(chosen, draw.random(chosen.shape).argsort(1)[:, :per_node], True, 1)
        best = np.full(k, -np.inf)
        feature, cut, left = np.full(k, -1), np.zeros(k, dtype=np.int64), np.zeros((k, 3))
        impurity = variance(*stats.T)
        for j, own in enumerate(splits):
            if not len(own) or not chosen[:, j].any():
                continue
            nb = len(own) + 1
            use = chosen[at, j]
            cell = at[use] * nb + bins[rows[use], j]
            below = np.stack([np.bincount(cell, sums[rows[use], c], k * nb).reshape(k, nb).cumsum(1)[:, :-1] for c in range(3)])
            above = stats.T[:, :, None] - below
            w = stats[:, 0][:, None]
            gain = impurity[:, None] - below[0] / w * variance(*below) - above[0] / w * variance(*above)
            gain = np.where((below[0] >= 1) & (above[0] >= 1) & chosen[:, j][:, None], gain, -np.inf)
            top = gain.argmax(1)
            here = gain[np.arange(k), top]
            better = here > best
            best = np.where(better, here, best)
            feature, cut = np.where(better, j, feature), np.where(better, top, cut)
            left[better] = below[:, np.arange(k), top].T[better]
        new, place = [], np.full((k, 2), -1)
        for n in np.flatnonzero(best > 0):
            node = tree[live[n]]
            node |= {"gain": float(best[n]), "feature": int(feature[n]), "threshold": float(splits[feature[n]][cut[n]]), "children": (len(tree), len(tree) + 1)}
            for side, s in enumerate((left[n], stats[n] - left[n])):
                child = {"stats": s, "impurity": float(variance(*s))}
                if child["impurity"] >= _EPSILON:
                    place[n, side] = len(new)
                    new.append(len(tree))
                tree.append(child)
        right = bins[rows, np.maximum(feature, 0)[at]] > cut[at]
        at = place[at, right.astype(np.int64)]
        rows, at = rows[at >= 0], at[at >= 0]
        live = new
    out: list[dict] = []

    def put(i: int) -> int:
        node, own = tree[i], len(out)
        w, s, q = map(float, node["stats"])
        out.append({"id": own, "prediction": s / w if w else 0.0, "impurity": node["impurity"], "w": w, "s": s, "q": q, "gain": node.get("gain", -1.0),
                    "leftChild": -1, "rightChild": -1, "feature": node.get("feature", -1), "threshold": node.get("threshold")})
        if "children" in node:
            out[own]["leftChild"], out[own]["rightChild"] = (put(c) for c in node["children"])
        return own
    put(0)
    return out


def _grower(splits: list[np.ndarray], strides: list[int], depth: int, per_node: int, seed: int):
    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")  # sums are rounded the same way, however the rows arrive
        code, w, s, q = (np.frombuffer(b"".join(t[c].to_pylist()), dtype=np.int64 if c == "codes" else np.float64) for c in ("codes", "w", "s", "q"))
        own, place = np.unique(code, return_inverse=True)
        sums = np.stack([np.bincount(place, x, len(own)) for x in (w, s, q)], axis=1)
        bins = np.stack([own // stride % (len(x) + 1) for x, stride in zip(splits, strides, strict=True)], axis=1).astype(np.uint8)
        tree = t["tree"][0].as_py()
        nodes = grow(bins, sums, splits, depth, per_node, np.random.default_rng([seed, tree, 1 << 31]))
        return pa.Table.from_pylist([{"treeID": tree, **n} for n in nodes], _SCHEMA)
    return one


_SCHEMA = pa.schema([(n, {"int": pa.int32(), "double": pa.float64()}[k]) for n, k in (x.strip().split(" ") for x in _NODES.split(","))])


def fit(feats: DataFrame, n: int, trees: int, depth: int, seed: int):
    """A fitted ``RandomForestRegressionModel`` of (features, label), or None if the rows have too many codes."""
    from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
    spark = feats.sparkSession
    rows = feats.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    head = rows.first()
    if head is None or not 0 < len(head["x"]) <= 62:
        return None
    seen = rows.select("x") if n <= SAMPLE else rows.select("x").sample(False, min(1.0, SAMPLE / n), seed)
    x = np.array([r["x"] for r in seen.collect()], dtype=np.float64).reshape(-1, len(head["x"]))  # about SAMPLE rows of few features
    if not len(x):
        return None
    splits = [thresholds(c, min(BINS, n)) for c in x.T]
    strides, size = [], 1
    for s in splits:
        strides.append(size)
        size *= len(s) + 1
    if size >= 1 << 62:
        return None
    coded = rows.mapInArrow(_coder(splits, strides), "code long, y double")
    parts, dealt = max(1, -(-n // ROWS_PER_TASK)), coded.coalesce(1)
    if parts > 1 or n > CODES:
        counted = cut_lineage(coded.groupBy("code").agg(F.count(F.lit(1)).alias("m")))
        if size > CODES and counted.count() > CODES:
            return None
        # frequent codes are cut up by place; there are CODES of them at most
        most = max(1, ROWS_PER_TASK // 4)
        often = counted.where(F.col("m") > most).select("code", F.ceil(F.col("m") / most).alias("cuts"))
        placed = coded.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(often), "code", "left")
        dealt = placed.select("code", "y", F.pmod("place", F.coalesce("cuts", F.lit(1))).alias("cut")).repartition(parts, "code", "cut").select("code", "y")
    sums = dealt.mapInArrow(_weigher(trees, seed), _SUMS)
    per_node = -(-len(splits) // 3) if trees > 1 else len(splits)
    grown = sums.repartition(min(trees, max(1, spark.sparkContext.defaultParallelism) * 2), "tree").groupBy("tree").applyInArrow(
        _grower(splits, strides, depth, per_node, seed), _NODES)
    # the model as Spark saves it: all but the nodes from a forest over two rows
    path = f"{checkpoint_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    zero = Vectors.dense([0.0] * len(splits))
    shell = spark.createDataFrame([(zero, 0.0), (zero, 1.0)], ["features", "label"]).coalesce(1)
    RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(shell).write().save(path)
    split = F.struct(F.col("feature").alias("featureIndex"), F.when(F.col("threshold").isNull(), F.array().cast("array<double>")).otherwise(
        F.array("threshold")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    grown.select("treeID", F.struct("id", "prediction", "impurity", F.array("w", "s", "q").alias("impurityStats"), F.col("w").cast("long").alias("rawCount"),
                                    "gain", "leftChild", "rightChild", split.alias("split")).alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)
