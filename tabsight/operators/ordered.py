"""Order-dependent primitives that stay distributed at any size.

A window without ``partitionBy`` (running totals, global row numbers) plans an
``Exchange SinglePartition``: every row goes through one task.  These helpers
split the ordered domain into value buckets whose boundaries come from
``percentile_approx`` (a bounded sketch per group), run the window inside each
(group, bucket), and add per-bucket offsets from a small totals table.  All
expressions are deterministic, so a lost task recomputes the same rows, and no
result depends on physical partition ids.

Callers pass tables whose order key is unique within a group (value counts,
distinct scores, rows with a unique tie-break), so one heavy value can never
overload a bucket: heavy values are one row after counting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

# Tables up to this many rows may be broadcast (offsets, targets, boundaries).
BROADCAST_ROW_LIMIT = 2_000_000
# Inputs with at most this many rows (counted, not assumed) run one window per group: the whole
# input is then bounded, so no task can receive more; larger inputs take the bucketed path.
SINGLE_WINDOW_ROWS = 500_000


def _buckets(spark, n_buckets: int | None) -> int:
    if n_buckets:
        return n_buckets
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast hint only when the side is proven small; otherwise a normal (shuffle) join."""
    n = small.count()
    return F.broadcast(small) if n <= limit else small


def _few(side: DataFrame, width: int = 1) -> DataFrame:
    """A side of a row per group, written once: broadcast if its cells are few, as a shuffle by group would send all rows of a
    group to one task."""
    from tabsight.session import cut_lineage
    return checked_broadcast(cut_lineage(side), BROADCAST_ROW_LIMIT // max(1, width))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the key columns of ``left`` are kept. Without keys ``right`` is one row."""
    if not keys:
        return left.crossJoin(right)
    other = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def _position(bounds: Column, heads: Column, step: int, key: Column) -> Column:
    """How many of the sorted ``bounds`` are below ``key``: a scan of every step-th bound, then of one stretch."""
    skip = F.size(F.filter(heads, lambda x: x < key)) * step
    return skip + F.size(F.filter(F.slice(bounds, skip + 1, step), lambda x: x < key))


def with_value_bucket(df: DataFrame, group_cols: list[str], order_col: str, n_buckets: int | None = None,
                      accuracy: int = 10000) -> DataFrame:
    """Adds ``_bucket`` in [0, B): the number of approximate B-quantile boundaries below the value.

    Cost per row grows with the square root of B.  NULL groups are groups of their own; a NULL value falls
    into bucket 0.  The bounds (one row per group) are broadcast if they prove small."""
    b = _buckets(df.sparkSession, n_buckets)
    probs, step = [i / b for i in range(1, b)], max(1, math.isqrt(b))
    key = F.col(order_col).cast("double")
    sketch = F.percentile_approx(key, probs, accuracy).alias("_bounds")
    if not group_cols:
        bounds = sorted(x for x in (df.agg(sketch).first()["_bounds"] or []) if x is not None)
        if not bounds:
            return df.withColumn("_bucket", F.lit(0))
        heads = F.lit(bounds[step - 1::step]) if len(bounds) >= step else F.array().cast("array<double>")
        return df.withColumn("_bucket", F.coalesce(F.when(key.isNotNull(), _position(F.lit(bounds), heads, step, key)), F.lit(0)))
    bounds = df.groupBy(*group_cols).agg(sketch).withColumn(
        "_heads", F.filter("_bounds", lambda x, i: i % step == step - 1))
    place = F.when(key.isNotNull() & F.col("_bounds").isNotNull(), _position(F.col("_bounds"), F.col("_heads"), step, key))
    return null_safe_join(df, _few(bounds, b), group_cols, "left").withColumn("_bucket", F.coalesce(place, F.lit(0))).drop("_bounds", "_heads")


def prefix_sum(df: DataFrame, group_cols: list[str], order_col: str, weights: dict[str, Column | str],
               ascending: bool = True, n_buckets: int | None = None, tiebreak: list[str] | None = None,
               n_rows: int | None = None, parts: int | None = None) -> DataFrame:
    """Running (inclusive) sums of each weight in ``order_col`` order within ``group_cols``.

    ``order_col`` (plus ``tiebreak`` columns) must be unique within a group.  NULL groups count as groups.  Rows with equal
    ``order_col`` always share a bucket, so ties are ordered by ``tiebreak`` inside it.
    Output keeps every input column and adds one column per ``weights`` key.
    ``parts``: partitions of the window, for callers whose groups are few and who know how many rows there are.
    """
    wcols = {k: (F.col(v) if isinstance(v, str) else v) for k, v in weights.items()}
    base = df
    for k, c in wcols.items():
        base = base.withColumn(f"_w_{k}", c.cast("double") if not isinstance(c, str) else c)
    sort_key = [F.col(order_col) if ascending else F.col(order_col).desc()] + \
        [F.col(t) if ascending else F.col(t).desc() for t in (tiebreak or [])]
    if n_rows is not None and n_rows <= SINGLE_WINDOW_ROWS and n_buckets is None:
        w = Window.partitionBy(*group_cols).orderBy(*sort_key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = base.select("*", *[F.sum(f"_w_{k}").over(w).alias(k) for k in wcols])
        return out.drop(*[f"_w_{k}" for k in wcols])
    # bucket on the ascending key; with descending order the bucket order is reversed
    b = with_value_bucket(base, group_cols, order_col, n_buckets)
    if not ascending:
        b = b.withColumn("_bucket", -F.col("_bucket"))
    w_local = (Window.partitionBy(*group_cols, "_bucket").orderBy(*sort_key)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = (b.repartition(parts, *group_cols, "_bucket") if parts else b).select("*", *[F.sum(f"_w_{k}").over(w_local).alias(f"_loc_{k}") for k in wcols])
    totals = b.groupBy(*group_cols, "_bucket").agg(*[F.sum(f"_w_{k}").alias(f"_tot_{k}") for k in wcols])
    w_off = (Window.partitionBy(*group_cols).orderBy("_bucket")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group_cols, "_bucket",
                            *[F.coalesce(F.sum(f"_tot_{k}").over(w_off), F.lit(0.0)).alias(f"_off_{k}")
                              for k in wcols])
    # one row per (group, bucket): left to Spark to broadcast if it proves small
    out = null_safe_join(local, F.broadcast(offsets) if parts else offsets, [*group_cols, "_bucket"])
    for k in wcols:
        out = out.withColumn(k, F.col(f"_loc_{k}") + F.col(f"_off_{k}"))
    drop = ["_bucket"] + [f"_w_{k}" for k in wcols] + [f"_loc_{k}" for k in wcols] + [f"_off_{k}" for k in wcols]
    return out.drop(*drop)


def value_counts_num(long_df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """(group, value, _cnt) for non-null values; map-side combined, so heavy values cost one row."""
    return (long_df.where(F.col(value_col).isNotNull())
                   .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("_cnt")))


def exact_quantiles_from_counts(vc: DataFrame, group_cols: list[str], value_col: str,
                                probs: list[float], n_buckets: int | None = None,
                                n_rows: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas ``quantile`` / SQL ``quantile_cont``).

    ``vc`` holds (group, value, _cnt) with unique values per group.  Position
    h = (n-1)p; result = x[floor h] + (x[floor h + 1] - x[floor h]) * (h - floor h).
    Returns (group..., p, q).
    """
    cum = prefix_sum(vc, group_cols, value_col, {"_cum": "_cnt"}, n_buckets=n_buckets, n_rows=n_rows)
    n = vc.groupBy(*group_cols).agg(F.sum("_cnt").alias("_n"))
    plist = F.array(*[F.lit(float(p)) for p in probs])
    targets = (n.select(*group_cols, "_n", F.explode(plist).alias("p"))
                .withColumn("_h", (F.col("_n") - 1).cast("double") * F.col("p"))
                .withColumn("_lo", F.floor("_h"))
                .withColumn("_frac", F.col("_h") - F.col("_lo")))
    # targets: one row per (group, p)
    hit = (null_safe_join(cum, _few(targets) if group_cols else targets, group_cols)
              .where(((F.col("_cum") - F.col("_cnt")) <= F.col("_lo") + 1) & (F.col("_cum") > F.col("_lo"))))
    agg = hit.groupBy(*group_cols, "p").agg(
        F.min(value_col).alias("_xlo"), F.max(value_col).alias("_xhi"), F.first("_frac").alias("_frac"))
    return agg.select(*group_cols, "p",
                      (F.col("_xlo") + (F.col("_xhi") - F.col("_xlo")) * F.col("_frac")).alias("q"))


def exact_quantiles(long_df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                    n_buckets: int | None = None) -> DataFrame:
    """Value counts are written once: bucket bounds, the prefix window, totals and targets all read them."""
    from tabsight.session import cut_lineage
    vc = cut_lineage(value_counts_num(long_df, group_cols, value_col))
    return exact_quantiles_from_counts(vc, group_cols, value_col, probs, n_buckets, n_rows=vc.count())


#: Error of a quantile sketch is 1/ACCURACY of the rows; groups of up to SMALL_GROUP rows need no sketch.
ACCURACY = 10_000
SMALL_GROUP = 3 * ACCURACY


def quantile_marks(probs: list[float]) -> list[float]:
    """Shares of the rows that surely lie below and above each wanted quantile in a large group."""
    return [min(1.0, max(0.0, p + s * 3 / ACCURACY)) for p in probs for s in (-1, 1)]


def sketch(value: Column | str, probs: list[float]) -> Column:
    return F.percentile_approx(value, quantile_marks(probs), ACCURACY)


def unpivoted(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(column, x) for every value that isn't missing."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("x")) for c, v in values.items()]))).where("x is not null")


def column_quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], scanned: dict[str, dict] | None = None) -> dict[str, dict[float, float]]:
    """Exact linear-interpolation quantiles of columns by selection, without shuffling the values: column -> {p: q}.

    One scan bounds every quantile by a mergeable sketch; a second counts the rows between the bounds and the values inside
    them (a few ten-thousandths of the rows, counted on the map side first), from which the exact order statistics are
    picked.  If a sketch should miss its promise, which the counts show, that column's values are all counted instead.
    What the driver holds is a few numbers per column.

    ``scanned``: column -> {n, min, max, marks} where a caller has already scanned the values."""
    from tabsight.session import cut_lineage
    probs, spark = sorted(probs), df.sparkSession
    marks = quantile_marks(probs)
    if scanned is None:
        scanned = {r["column"]: r.asDict() for r in unpivoted(df, values).groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), sketch("x", probs).alias("marks")).collect()}
    scanned = {c: r for c, r in scanned.items() if c in values and r["n"]}
    if not scanned:
        return {}
    k = len(probs)
    bounds = []
    for c, r in scanned.items():
        whole = r["n"] <= SMALL_GROUP
        bounds.append((c, *(float(r["min"] if whole or marks[2 * i] == 0 else r["marks"][2 * i]) for i in range(k)),
                       *(float(r["max"] if whole or marks[2 * i + 1] == 1 else r["marks"][2 * i + 1]) for i in range(k))))
    # regions in order: 2i + 1 lies within the bounds of quantile i, even ones lie between; only values within bounds are kept
    region = F.lit(2 * k)
    for i in reversed(range(k)):
        region = F.when(F.col("x") < F.col(f"low{i}"), 2 * i).when(F.col("x") <= F.col(f"high{i}"), 2 * i + 1).otherwise(region)
    names = [f"{side}{i}" for side in ("low", "high") for i in range(k)]
    limits = F.broadcast(spark.createDataFrame(bounds, "column string, " + ", ".join(f"{n} double" for n in names)))  # a row per column
    placed = unpivoted(df, {c: values[c] for c in scanned}).join(limits, "column").select("column", "x", region.alias("region"))
    placed = placed.select("column", "region", F.when(F.col("region") % 2 == 1, F.col("x")).alias("x"))
    counts = cut_lineage(placed.groupBy("column", "region", "x").agg(F.count(F.lit(1)).alias("n")))
    held: dict[str, dict[int, int]] = {c: {} for c in scanned}
    inside = 0
    for r in counts.groupBy("column", "region").agg(F.sum("n").alias("n"), F.count("x").alias("k")).collect():  # a few rows per column
        held[r["column"]][r["region"]] = r["n"]
        inside += r["k"]
    wanted, missed = [], []
    for c, by in held.items():
        for p in probs:
            h = (scanned[c]["n"] - 1) * p
            lo = int(h)
            upto, where = 0, []
            for region in sorted(by):
                where += [region] * ((upto <= lo < upto + by[region]) + (h > lo and upto <= lo + 1 < upto + by[region]))
                upto += by[region]
            if any(x % 2 == 0 for x in where):
                missed.append(c)
            wanted.append((c, p, lo, h - lo))
    offsets = [(c, region, sum(n for x, n in by.items() if x < region and x % 2 == 0)) for c, by in held.items() for region in by if region % 2]
    cum = prefix_sum(counts.where("x is not null"), ["column"], "x", {"cum": "n"}, n_rows=inside)
    # a few rows per column
    cum = cum.join(F.broadcast(spark.createDataFrame(offsets, "column string, region int, before long")), ["column", "region"])
    upto = F.col("cum") + F.col("before")
    targets = F.broadcast(spark.createDataFrame(wanted, "column string, p double, lo long, frac double"))
    hit = cum.join(targets, "column").where((upto - F.col("n") <= F.col("lo") + 1) & (upto > F.col("lo")))
    out: dict[str, dict[float, float]] = {}
    for r in hit.groupBy("column", "p").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.first("frac").alias("frac")).collect():
        out.setdefault(r["column"], {})[r["p"]] = r["a"] + (r["b"] - r["a"]) * r["frac"]
    for c in set(missed):
        own = df.select(F.lit(c).alias("column"), values[c].alias("x"))
        out[c] = {r["p"]: r["q"] for r in exact_quantiles(own, ["column"], "x", probs).collect()}
    return out


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group; ``row_number <= k`` lets Spark insert a partial
    WindowGroupLimit before the shuffle, so only k rows per group per task move."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def order_statistic_cut(df: DataFrame, time_col: str, key_col: str, cut_rank: int,
                        n_buckets: int | None = None) -> DataFrame:
    """Rows whose position in (time, key) order is < ``cut_rank``.

    Counting per distinct time value makes a heavy timestamp one row; only the
    rows sharing the boundary timestamp are ranked by key (keys are unique, so
    that ranking is bucketed and balanced too).  Returns ``df`` + ``_first`` flag.
    """
    tc = df.groupBy(time_col).agg(F.count(F.lit(1)).alias("_cnt"))
    tc = tc.withColumn("_tnum", _numeric_key(df, time_col))
    cum = prefix_sum(tc, [], "_tnum", {"_cum": "_cnt"}, n_buckets=n_buckets)
    boundary = cum.where((F.col("_cum") - F.col("_cnt") < cut_rank) & (F.col("_cum") >= cut_rank))
    brow = boundary.select(time_col, (F.lit(cut_rank) - (F.col("_cum") - F.col("_cnt"))).alias("_need")).first()
    if brow is None:  # cut beyond the table: everything is first
        return df.withColumn("_first", F.lit(cut_rank > 0))
    t_star, need = brow[0], int(brow[1])
    at = df.where(F.col(time_col) == F.lit(t_star))
    keyed = at.select(key_col).withColumn("_one", F.lit(1))
    kcum = prefix_sum(keyed.withColumn("_knum", _numeric_key(df, key_col)), [], "_knum", {"_kc": "_one"},
                      n_buckets=n_buckets, tiebreak=[key_col])
    chosen = kcum.where(F.col("_kc") <= need).select(key_col, F.lit(True).alias("_pick"))
    out = df.join(chosen, key_col, "left")
    return out.withColumn("_first", (F.col(time_col) < F.lit(t_star)) |
                          ((F.col(time_col) == F.lit(t_star)) & F.coalesce(F.col("_pick"), F.lit(False)))).drop("_pick")


def _numeric_key(df: DataFrame, col: str) -> Column:
    """Order-preserving double for numeric and datetime columns; other types are ordered by their md5 key."""
    if _is_ts(df, col):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if not _is_number(df, col):
        from tabsight.functions.exprs import hash_rank_key
        return hash_rank_key(F.col(col)).cast("double")
    return F.col(col).cast("double")


def _is_ts(df: DataFrame, col: str) -> bool:
    from pyspark.sql import types as T
    return isinstance(df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _is_number(df: DataFrame, col: str) -> bool:
    from pyspark.sql import types as T
    return isinstance(df.schema[col].dataType, (T.NumericType, T.BooleanType))
