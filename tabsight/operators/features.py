"""Time-series features (W1-W3, F3, K1, P5, X9, M6) and chronological splits.

Series up to a size bound use one window per series.  Larger series (including a
single keyless series or one hot key) are cut into index blocks; each block also
receives the last rows of the previous block as a halo, so every window still sees
its full history while no task holds a whole large series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.functions.exprs import as_double
from tabsight.operators.ordered import SINGLE_WINDOW_ROWS, order_statistic_cut, prefix_sum
from tabsight.session import cut_lineage

# Fixed defaults of the feature builder.
DEFAULT_LAGS = [1, 2, 3, 7, 14, 28]
DEFAULT_WINDOWS = [7, 14, 28]
# Below the size from which series are cut, so that a cut series always falls into several blocks.
BLOCK_ROWS = 250_000


def _is_float(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() in ("float", "double")


def calendar_features(df: DataFrame, time_col: str) -> DataFrame:
    """Monday-0 weekday, day, month, year, weekend flag."""
    t = F.col(time_col)
    return (df.withColumn("cal_dayofweek", F.weekday(t))
              .withColumn("cal_day", F.dayofmonth(t))
              .withColumn("cal_month", F.month(t))
              .withColumn("cal_year", F.year(t))
              .withColumn("cal_is_weekend", (F.weekday(t) >= 5).cast("int")))


def _window_features(w: Window, target: str, lags: list[int], windows: list[int]) -> list[Column]:
    t = F.col(target)
    cols = [F.lag(t, k).over(w).alias(f"target_lag_{k}") for k in lags]
    for n in windows:
        frame = w.rowsBetween(-n, -1)
        cols.append(F.avg(t).over(frame).alias(f"target_roll_mean_{n}"))
        cols.append(F.coalesce(F.stddev_samp(t).over(frame), F.lit(0.0)).alias(f"target_roll_std_{n}"))
    return cols


def lag_features(df: DataFrame, time_col: str, target: str, group_cols: list[str] | None = None,
                 lags: list[int] | None = None, windows: list[int] | None = None,
                 block_rows: int = BLOCK_ROWS, drop_incomplete: bool = True,
                 max_series_rows: int = SINGLE_WINDOW_ROWS) -> DataFrame:
    """W1-W3 (+F3, P5): lags, trailing rolling mean/std of the previous n rows (shift 1, at least
    one observation; std of one observation is 0), calendar parts; rows without the first lag
    are dropped.  Times must be unique within a series.

    The size of the largest series decides the plan: up to ``max_series_rows`` rows one window per
    series; beyond that every series is cut into index blocks and each block also receives the last
    rows of the previous block of the same series as a halo, so a hot series is spread over many
    tasks and every window still sees its full history."""
    lags = lags or DEFAULT_LAGS
    windows = windows or DEFAULT_WINDOWS
    g = list(group_cols or [])
    base = calendar_features(df.withColumn(target, as_double(target)) if _is_float(df, target) else df, time_col)
    sizes = base.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")) if g else base.agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.agg(F.max("_n")).first()[0] or 0
    if largest <= max_series_rows:
        w = Window.partitionBy(*g).orderBy(time_col)
        out = base.select("*", *_window_features(w, target, lags, windows))
    else:
        halo = max(lags + windows)
        tnum = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double")
        idx = prefix_sum(base.withColumn("_t", tnum), g, "_t", {"_idx": F.lit(1)}) \
            .withColumn("_idx", F.col("_idx").cast("long") - 1).drop("_t")
        idx = idx.withColumn("_block", F.floor(F.col("_idx") / block_rows))
        own = idx.withColumn("_halo", F.lit(False))
        # the last `halo` rows of block b also join block b+1 of the same series as history only
        copy = idx.where(F.col("_idx") % block_rows >= block_rows - halo) \
            .withColumn("_block", F.col("_block") + 1).withColumn("_halo", F.lit(True))
        both = own.unionByName(copy)
        w = Window.partitionBy(*g, "_block").orderBy("_idx")
        out = both.select("*", *_window_features(w, target, lags, windows)) \
            .where(~F.col("_halo")).drop("_block", "_halo", "_idx")
    if drop_incomplete:
        out = out.where(F.col(f"target_lag_{lags[0]}").isNotNull())
    return out


def seasonal_naive(df: DataFrame, time_col: str, target: str, group_cols: list[str] | None = None,
                   season: int = 7) -> DataFrame:
    """M6: forecast = value one season earlier (no fit); rows without history get NULL."""
    f = lag_features(df, time_col, target, group_cols, lags=[season], windows=[1], drop_incomplete=False)
    return f.withColumn("forecast", F.col(f"target_lag_{season}")).drop(
        f"target_lag_{season}", "target_roll_mean_1", "target_roll_std_1")


def chronological_split(df: DataFrame, time_col: str, key_col: str, test_size: float = 0.2) -> DataFrame:
    """The first int(n * (1 - test_size)) rows in (time, key) order are 'train', the rest 'test'.

    The cut is an order statistic found by counting (see ``order_statistic_cut``): no global sort."""
    n = df.count()
    cut = int(n * (1.0 - test_size))
    marked = order_statistic_cut(df, time_col, key_col, cut)
    return marked.withColumn("split", F.when(F.col("_first"), "train").otherwise("test")).drop("_first")


def walk_forward_folds(df: DataFrame, time_col: str, n_folds: int = 3) -> DataFrame:
    """X11: expanding-window folds: the distinct times are cut into n_folds+1 consecutive blocks by
    position; fold i trains on the rows of blocks < i and validates on those of block i.  Rows of one time (of
    several series) are never split.

    Output: input columns + fold (1..n_folds) + role ('train' / 'validation'), rows repeated per fold."""
    times = cut_lineage(df.select(time_col).where(F.col(time_col).isNotNull()).distinct())
    n = times.count()
    tnum = F.unix_micros(F.col(time_col).cast("timestamp")).cast("double")
    idx = prefix_sum(times.withColumn("_t", tnum), [], "_t", {"_idx": F.lit(1)}, n_rows=n).drop("_t")
    blk = idx.withColumn("_blk", F.floor((F.col("_idx") - 1) * (n_folds + 1) / F.lit(max(n, 1))).cast("int"))
    folds = F.sequence(F.greatest(F.col("_blk"), F.lit(1)), F.lit(n_folds))
    out = df.join(blk, time_col).where(F.col("_blk") <= n_folds).withColumn("fold", F.explode(folds))
    return out.withColumn("role", F.when(F.col("_blk") == F.col("fold"), "validation").otherwise("train")) \
              .drop("_idx", "_blk")


def series_are_keyed(df: DataFrame, time_col: str, group_cols: list[str] | None = None) -> bool:
    """Whether every time occurs once in its series (lags are undefined otherwise)."""
    twice = df.where(F.col(time_col).isNotNull()).groupBy(*(group_cols or []), time_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return twice.isEmpty()
