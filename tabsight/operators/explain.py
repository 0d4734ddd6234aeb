"""Explainability.

I1: native importance (tree ``featureImportances`` / linear |coefficients|) as % of the total.
I2: mean |SHAP| over *all* rows: exact for linear models (mean |w_j (x_j - mean_j)|, one aggregation), path-dependent
    for trees and their ensembles (``treeshap``), native importance for the rest.
I3: reduction of long SHAP outputs (row, class, feature, value) to mean |value| per feature.
I4: permutation importance: each feature's values are re-paired across rows by an md5 order (one shuffle by position for
    all features, not a driver shuffle), the model rescored, the metric drop reported.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from tabsight.functions import exprs as X
from tabsight.operators import metrics as M
from tabsight.operators import treeshap
from tabsight.operators.ordered import prefix_sum
from tabsight.session import cut_lineage

TOP_N = 15


def native_importance(spark, exp, top_n: int = TOP_N) -> DataFrame:
    """(rank, feature, importance, importance_pct) for the fitted champion."""
    names = exp.preprocessor.feature_names
    stages = exp.model.stages
    vals = None
    if stages:
        m = stages[0]
        if hasattr(m, "featureImportances"):
            acc = [0.0] * len(names)
            for st in stages:  # one model per class for multiclass boosting: average
                fi = st.featureImportances.toArray()
                acc = [a + float(b) / len(stages) for a, b in zip(acc, fi)]
            vals = acc
        elif hasattr(m, "coefficientMatrix"):
            cm = m.coefficientMatrix.toArray()
            vals = [float(abs(cm[:, j]).mean()) for j in range(cm.shape[1])]  # mean |coef| over classes (Q20)
        elif hasattr(m, "coefficients"):
            vals = [abs(float(x)) for x in m.coefficients.toArray()]
    if vals is None:
        vals = [0.0] * len(names)
    # one row per feature: bounded by the feature count
    df = spark.createDataFrame([(n, float(v)) for n, v in zip(names, vals)], "feature string, importance double")
    tot = df.agg(F.sum("importance")).scalar()
    ranked = df.withColumn("importance_pct", F.when(tot > 0, F.col("importance") / tot * 100).otherwise(0.0)) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))
    return ranked.where(F.col("rank") <= top_n)


def linear_shap(feats: DataFrame, weights: list[float], names: list[str], features_col: str = "features") -> DataFrame:
    """I2 (linear): exact mean |w_j (x_j - mean_j)| per feature over every row (two aggregations)."""
    arr = vector_to_array(features_col)
    k = len(names)
    means = feats.select(arr.alias("_x")).agg(*[F.avg(F.col("_x")[j]).alias(f"m{j}") for j in range(k)]).first()
    shap = feats.select(arr.alias("_x")).agg(*[
        F.avg(F.abs(F.lit(float(weights[j])) * (F.col("_x")[j] - F.lit(float(means[f"m{j}"] or 0.0))))).alias(f"s{j}")
        for j in range(k)])
    return shap.select(F.inline(F.array(*[F.struct(F.lit(names[j]).alias("feature"), F.col(f"s{j}").alias("mean_abs_shap"))
                                          for j in range(k)])))


def shap_importance(spark, exp, feats: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap) of a fitted champion over all rows of ``feats``; models without attributions give their
    native importance.  Of two classes the second counts, of more the mean over classes; boosting in one model per
    class is averaged over them, multinomial weights over their classes."""
    names, stages = exp.preprocessor.feature_names, exp.model.stages
    if stages and hasattr(stages[0], "featureImportances"):
        parts = [treeshap.explain_model(feats, m, names, 1 if exp.n_classes == 2 and exp.preset == "random_forest" else None) for m in stages]
    elif stages and hasattr(stages[0], "coefficientMatrix"):
        rows = [[float(x) for x in w] for w in stages[0].coefficientMatrix.toArray()]
        parts = [linear_shap(feats, w, names) for w in rows]
    elif stages and hasattr(stages[0], "coefficients"):
        parts = [linear_shap(feats, [float(x) for x in stages[0].coefficients.toArray()], names)]
    else:
        return native_importance(spark, exp, len(names)).select("feature", F.col("importance").alias("mean_abs_shap"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("feature").agg(F.avg("mean_abs_shap").alias("mean_abs_shap"))


def reduce_shap(long_values: DataFrame, positive_class: int | None = None) -> DataFrame:
    """Long (row, class, feature, value) -> mean |value| per feature; with two classes only the
    positive class counts, with more classes the per-class means are averaged."""
    lv = long_values
    if positive_class is not None:
        lv = lv.where(F.col("class") == positive_class)
    per_class = lv.groupBy("class", "feature").agg(F.avg(F.abs("value")).alias("m"))
    return per_class.groupBy("feature").agg(F.avg("m").alias("mean_abs_shap"))


#: Column of ``permuted`` that names the re-paired feature ("" for the rows as they are).
PERMUTED = "_permuted"
#: Rows of ``permuted``'s long table that one task of a shuffle gets, about.
ROWS_PER_TASK = 500_000


def permuted(data: DataFrame, key: str, columns: list[str], seed_text: str = "perm") -> DataFrame:
    """Every row of ``data`` as it is and once for each of ``columns``, with that column's values re-paired across rows.

    The row at position i of the md5 order of the keys gets the value of the row at position i of the md5 order of
    (key, seed, column).  All orders are one long table, so positions are one bucketed prefix sum and rows meet their
    new values in one shuffle by position, however many columns there are.  Equal keys are told apart by position; a null
    key orders as the empty text; an empty table gives no rows."""
    names = data.columns
    data = cut_lineage(data)  # bounds, totals and windows read it
    n = data.count()
    # tasks grow in number with the rows, not in size
    parts = max(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * (len(columns) + 1) // ROWS_PER_TASK))
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    feature, text = F.col(PERMUTED), F.coalesce(F.col(f"_own.c{names.index(key)}").cast("string"), F.lit(""))
    long = data.select(own.alias("_own"), F.explode(F.array(*[F.lit(c) for c in ["", *columns]])).alias(PERMUTED)).select(
        PERMUTED, X.hash_rank_key(F.when(feature == "", text).otherwise(F.concat(text, F.lit("|" + seed_text), feature))).cast("double").alias("_o"),
        F.col(f"_own.c{names.index(key)}").alias("_key"), F.when(feature == "", F.col("_own")).alias("_own"),
        *[F.when(feature == c, F.col(f"_own.c{names.index(c)}")).alias(f"_m{j}") for j, c in enumerate(columns)])
    placed = prefix_sum(long, [PERMUTED], "_o", {"_i": F.lit(1)}, tiebreak=["_key"], n_buckets=max(8, parts), parts=parts)
    rows = placed.withColumn("_i", F.col("_i").cast("long")).repartition(parts, "_i").groupBy("_i").agg(
        *[F.any_value(c, ignoreNulls=True).alias(c) for c in ["_own", *[f"_m{j}" for j in range(len(columns))]]])
    rows = cut_lineage(rows)  # one row a row of the data; metrics read it several times
    cells = {c: F.col(f"_own.c{i}") for i, c in enumerate(names)}
    new = {c: F.col(f"_m{j}") for j, c in enumerate(columns)}
    return rows.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias(PERMUTED), *[(new[c] if c == f else cells[c]).alias(c) for c in names]) for f in ["", *columns]])))


def permutation_importance(exp, data: DataFrame, key: str, seed_text: str = "perm") -> DataFrame:
    """I4: metric drop when one raw feature column is re-paired across rows (``permuted``); all features are
    scored in one pass, with one metric a feature."""
    rows = permuted(data, key, list(exp.numeric) + list(exp.categorical), seed_text)
    scores = _scores(exp.task, exp.model.predict(exp.preprocessor.transform(rows)), exp.n_classes)
    # one row per raw feature
    scores = cut_lineage(scores)
    base = scores.where(F.col(PERMUTED) == "").select(F.lit(1).alias("_k"), F.col("score").alias("base_score"))
    drop = F.col("base_score") - F.col("permuted_score")
    return scores.where(F.col(PERMUTED) != "").select(F.lit(1).alias("_k"), F.col(PERMUTED).alias("feature"), F.col("score").alias("permuted_score")) \
        .join(base, "_k").select("feature", "base_score", "permuted_score", (drop if exp.task == "classification" else -drop).alias("importance"))


def _scores(task: str, pred: DataFrame, n_classes: int) -> DataFrame:
    if task != "classification":
        out, score = M.regression_metrics(pred, "label", "prediction", [PERMUTED]), "rmse"
    elif n_classes == 2:
        out, score = M.ranking_metrics(pred, "label", "p", [PERMUTED]), "roc_auc"
    else:
        out, score = M.classification_metrics(pred, "label", "prediction", [PERMUTED], positive=None), "accuracy"
    return out.select(PERMUTED, F.col(score).alias("score"))
