"""Deterministic holdout split (X1), stratified k-fold ids (X10) and the CV guard.

Rows are ordered inside each class by an md5-derived key of their id (tie: the id),
so the assignment is independent of partitioning, reproducible in any SQL engine,
and the per-class positions come from bucketed prefix sums (a majority class
holding most rows is still spread over many tasks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions import exprs as X
from tabsight.operators import stats
from tabsight.operators.ordered import null_safe_join, prefix_sum


def _dec(x: float) -> Column:
    """Exact decimal literal: class quotas must not depend on binary rounding of n * share."""
    from decimal import Decimal
    return F.lit(Decimal(str(x)))


def _rank_in_group(df: DataFrame, group_cols: list[str], key_col: str, n_rows: int | None = None) -> DataFrame:
    """0-based position of each row inside its group in (md5 key, id) order: column ``_pos``."""
    keyed = df.withColumn("_h", X.hash_rank_key(F.col(key_col)).cast("double"))
    ranked = prefix_sum(keyed, group_cols, "_h", {"_pos": F.lit(1)}, tiebreak=[key_col], n_rows=n_rows)
    return ranked.withColumn("_pos", F.col("_pos").cast("long") - 1).drop("_h")


def holdout_split(df: DataFrame, key_col: str, target: str | None = None, test_size: float = 0.2,
                  stratify: bool = True) -> DataFrame:
    """Adds ``split`` ('train'/'test').

    Stratified (when ``target`` is given, ``stratify`` is set and every class has >= 2 rows):
    the first round(test_size * n_class) rows of each class in key order are 'test'.
    Otherwise the first ceil(test_size * n) rows overall are 'test'."""
    strat = False
    if target is not None and stratify:
        cs = stats.class_summary(df, target).first()
        strat = cs is not None and cs["n_classes"] > 1 and cs["minority_count"] >= 2
    if strat:
        g = "_cls"
        d = df.withColumn(g, F.col(target).cast("string"))
        sizes = d.groupBy(g).agg(F.count(F.lit(1)).alias("_n"))
        quota = F.round(F.col("_n") * _dec(test_size))
    else:
        g = "_cls"
        d = df.withColumn(g, F.lit("all"))
        sizes = d.groupBy(g).agg(F.count(F.lit(1)).alias("_n"))
        quota = F.ceil(F.col("_n") * _dec(test_size))
    sizes = sizes.withColumn("_q", quota)
    total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    ranked = _rank_in_group(d, [g], key_col, n_rows=total)
    # rows without a class form a class of their own: no row is lost
    out = null_safe_join(ranked, sizes, [g])
    return out.withColumn("split", F.when(F.col("_pos") < F.col("_q"), "test").otherwise("train")) \
              .drop(g, "_n", "_q", "_pos")


def stratified_folds(df: DataFrame, key_col: str, target: str | None, k: int = 3, n_rows: int | None = None) -> DataFrame:
    """Fold id = position in (md5 key, id) order within the class, modulo k (round robin),
    so every fold holds floor/ceil(n_class / k) rows of each class.  ``target`` None -> plain k-fold."""
    g = "_cls"
    d = df.withColumn(g, F.col(target).cast("string") if target else F.lit("all"))
    ranked = _rank_in_group(d, [g], key_col, n_rows=n_rows)
    return ranked.withColumn("fold", (F.col("_pos") % k).cast("int")).drop(g, "_pos")


def cv_allowed(n_rows: int, folds: int) -> bool:
    """Cross-validation runs only with more than one fold and at least 2 rows per fold."""
    return folds > 1 and n_rows >= 2 * folds
