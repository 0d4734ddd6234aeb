"""Full dataset profile (Z1) with the overview row (G6) and heat-map data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tabsight.operators import classify, quality, stats


@dataclass
class Profile:
    overview: DataFrame       # G6: one row
    column_stats: DataFrame   # A1-A12, T1
    top_values: DataFrame     # K2
    correlations: DataFrame   # A13 (list-wise)
    top_pairs: DataFrame      # K3
    heatmap: DataFrame        # G10
    preview: DataFrame        # T2/T3


def dataset_overview(df: DataFrame, col_stats: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and %, duplicate rows and %."""
    cs = col_stats.agg(F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols"),
                       F.sum("missing_count").alias("missing_cells"))
    dup = stats.duplicate_rows(df).select("duplicate_rows", "duplicate_pct")
    return cs.withColumn("_k", F.lit(1)).join(dup.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn(
        "missing_pct", F.col("missing_cells") * 100.0 / (F.col("n_rows") * F.col("n_cols")))


def full_profile(df: DataFrame, heatmap_columns: int = 15) -> Profile:
    cs = stats.column_stats(df)
    num = [r["column"] for r in cs.where(F.col("semantic_type") == "numeric").orderBy("ordinal").select("column").collect()]
    pairs = quality.correlation_pairs(df, num) if len(num) >= 2 else \
        df.sparkSession.createDataFrame([], "feature_1 string, feature_2 string, correlation double")
    first = num[:heatmap_columns]
    heat = pairs.where(F.col("feature_1").isin(first) & F.col("feature_2").isin(first))
    return Profile(dataset_overview(df, cs), cs, stats.top_categories(df, 10), pairs, quality.top_correlations(pairs),
                   heat, classify.profile_preview(df, cs))
