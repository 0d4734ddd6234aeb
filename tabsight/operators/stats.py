"""Column statistics in long format (one row per column), typed semantically.

Jobs for a full profile: one plain aggregation over the table (missing cells, datetime
ranges), one map-side-combined value count over an unpivoted (column, value) view (distinct
counts, modes, top-k, date-likeness), and three scans of the numeric columns that shuffle no
values (moments and sketches, exact quartiles by selection, outliers).  No per-column ``count_distinct``
(that plans an ``Expand`` of rows x columns) and no single-partition window.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tabsight.functions import exprs as X
from tabsight.operators.ordered import column_quantiles, sketch, top_k_per_group, unpivoted
from tabsight.session import cut_lineage


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    ordinal: int
    dtype: T.DataType

    @property
    def numeric(self) -> bool:
        return X.is_numeric_type(self.dtype)

    @property
    def temporal(self) -> bool:
        return X.is_datetime_type(self.dtype)

    @property
    def text(self) -> bool:
        return X.is_string_type(self.dtype)

    @property
    def integral(self) -> bool:
        return isinstance(self.dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def columns_of(df: DataFrame) -> list[ColumnInfo]:
    return [ColumnInfo(f.name, i, f.dataType) for i, f in enumerate(df.schema.fields)]


def _num_key(ci: ColumnInfo) -> Column:
    """Double value for statistics; -0.0 and 0.0 are one value, NaN is missing."""
    return X.as_double(ci.name) + F.lit(0.0)


def _str_key(ci: ColumnInfo) -> Column:
    """Text key of a value; NULL for floating columns (those group on their double value)."""
    if ci.numeric and not ci.integral:
        return F.lit(None).cast("string")
    return X.canonical_string(ci.name, ci.dtype)


def long_values(df: DataFrame, cols: list[ColumnInfo] | None = None) -> DataFrame:
    """Unpivot to (column, value string, num double) with one generator (no Expand)."""
    cols = cols if cols is not None else columns_of(df)
    structs = [F.struct(F.lit(c.name).alias("column"), _str_key(c).alias("value"),
                        (_num_key(c) if c.numeric else F.lit(None).cast("double")).alias("num"))
               for c in cols]
    return df.select(F.inline(F.array(*structs)))


def value_counts(df: DataFrame, cols: list[ColumnInfo] | None = None) -> DataFrame:
    """(column, value, num, count) for every non-null value of every column.

    Floating columns are keyed by their double value (``value`` is NULL, -0.0 folded into 0.0),
    integral and text columns by their exact text; map-side combined, so a heavy value is one row."""
    lv = long_values(df, cols).where(F.col("value").isNotNull() | F.col("num").isNotNull())
    return lv.groupBy("column", "value", "num").agg(F.count(F.lit(1)).alias("count")) \
             .withColumn("value", F.coalesce(F.col("value"), F.col("num").cast("string")))


def wide_aggregates(df: DataFrame, cols: list[ColumnInfo]) -> DataFrame:
    """One plain aggregation; result is long (column, ...) after unpivoting the single row."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for c in cols:
        p = f"c{c.ordinal}_"
        aggs.append(F.count_if(X.is_missing(c.name, c.dtype)).alias(p + "missing"))
        if c.temporal:
            t = F.col(c.name)
            aggs += [F.min(t).cast("timestamp_ntz").alias(p + "tmin"), F.max(t).cast("timestamp_ntz").alias(p + "tmax")]
    row = df.agg(*aggs)

    def g(c: ColumnInfo, k: str, typ: str) -> Column:
        name = f"c{c.ordinal}_{k}"
        return F.col(name).cast(typ) if name in row.columns else F.lit(None).cast(typ)

    structs = []
    for c in cols:
        structs.append(F.struct(
            F.lit(c.name).alias("column"), F.lit(c.ordinal).alias("ordinal"),
            F.lit(c.dtype.simpleString()).alias("dtype"),
            F.col("__rows").alias("n_rows"), g(c, "missing", "long").alias("missing_count"),
            g(c, "tmin", "timestamp_ntz").alias("tmin"), g(c, "tmax", "timestamp_ntz").alias("tmax"),
            F.lit(c.numeric).alias("is_numeric"), F.lit(c.temporal).alias("is_temporal"),
            F.lit(c.text).alias("is_text"), F.lit(X.id_like_name(c.name.lower())).alias("id_name"),
        ))
    return row.select(F.inline(F.array(*structs)))


#: Columns in one aggregation: beyond 128 keys Spark would sort the rows for it.
COLUMNS_PER_SCAN = 100
QUARTILES = [0.25, 0.5, 0.75]
SUMMARY = ("column string, num_count long, mean double, std_raw double, min double, max double, g1 double, g2 double, zero_count long, "
           "q25 double, median double, q75 double, outlier_count long")


def numeric_summary(df: DataFrame, cols: list[ColumnInfo], quantiles: bool = True) -> DataFrame:
    """One row per numeric column: column, num_count, mean, std_raw, min, max, g1, g2, zero_count and, with
    ``quantiles``, q25, median, q75, outlier_count (else NULL).

    No value is shuffled: the first scan gathers moments, extremes and sketches per column, the second picks the exact quartiles
    (``column_quantiles``), the third counts what lies outside their fences.  g1 and g2 are the population skewness
    and excess kurtosis (bias correction is applied by the caller)."""
    rows: list[tuple] = []
    for i in range(0, len(cols), COLUMNS_PER_SCAN):
        rows += _summary(df, cols[i:i + COLUMNS_PER_SCAN], quantiles)
    return df.sparkSession.createDataFrame(rows, SUMMARY)  # one row per column


def _summary(df: DataFrame, cols: list[ColumnInfo], quantiles: bool) -> list[tuple]:
    values = {c.name: _num_key(c) for c in cols}
    x = F.col("x")
    long = unpivoted(df, values)
    # the sketches are aggregated by themselves: beside them, the others would run without generated code
    jobs = [long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std_raw"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), F.sum((x == 0).cast("long")).alias("zeros"))]
    if quantiles:
        jobs.append(long.groupBy("column").agg(sketch(x, QUARTILES).alias("marks")))
    with ThreadPoolExecutor(max_workers=2) as pool:
        found = list(pool.map(lambda job: {r["column"]: r.asDict() for r in job.collect()}, jobs))  # a row per column
    first = {c: {**r, **(found[1][c] if quantiles else {})} for c, r in found[0].items()}
    q = column_quantiles(df, values, QUARTILES, first) if quantiles else {}
    outside = {}
    if q:
        fences = {c: (v[0.25] - 1.5 * (v[0.75] - v[0.25]), v[0.75] + 1.5 * (v[0.75] - v[0.25])) for c, v in q.items()}
        outside = df.agg(*[F.count_if((values[c] < F.lit(low)) | (values[c] > F.lit(high))).alias(c) for c, (low, high) in fences.items()]).first().asDict()
    return [(c, r["n"], r["mean"], r["std_raw"], r["min"], r["max"], r["g1"], r["g2"], r["zeros"], *(q.get(c, {}).get(p) for p in QUARTILES), outside.get(c)) for c, r in first.items()]


def distinct_summary(vc: DataFrame, text_cols: list[str] | None = None) -> DataFrame:
    """(column, n_distinct, non_null, top_value, top_freq); mode ties go to the smallest value.

    With ``text_cols`` the same aggregation also yields the date-likeness of those columns
    (F1/F2 weighted by counts: each distinct string is tested once)."""
    aggs = [F.count(F.lit(1)).alias("n_distinct"), F.sum("count").alias("non_null"),
            F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("top_value"),
            F.max("count").alias("top_freq")]
    if text_cols:
        is_t = F.col("column").isin(text_cols)
        like = is_t & X.date_like(F.col("value"))
        parsed = F.when(like, X.parse_datetime(F.col("value")))
        aggs += [F.sum(F.when(is_t, F.col("count"))).alias("text_non_null"),
                 F.coalesce(F.sum(F.when(like, F.col("count"))), F.lit(0)).alias("date_like"),
                 F.coalesce(F.sum(F.when(parsed.isNotNull(), F.col("count"))), F.lit(0)).alias("date_parsed"),
                 F.min(parsed).cast("timestamp_ntz").alias("ttmin"), F.max(parsed).cast("timestamp_ntz").alias("ttmax")]
    return vc.groupBy("column").agg(*aggs)


def date_candidate(is_temporal: Column, is_text: Column, text_non_null: Column, date_like: Column, date_parsed: Column) -> Column:
    """Whether a column holds dates: by its type, or as text that looks and parses like dates."""
    share = F.greatest(text_non_null, F.lit(1)).cast("double")
    text_date = is_text & (text_non_null > 0) & (date_like / share >= X.DATE_MATCH_SHARE) & (date_parsed / share >= X.DATE_PARSE_SHARE)
    return F.coalesce(is_temporal | text_date, F.lit(False))


def semantic_type(n_distinct: Column, n_rows: Column, id_name: Column, is_date: Column, is_numeric: Column) -> Column:
    """constant -> id -> datetime -> numeric -> categorical (first match wins)."""
    nd = F.coalesce(n_distinct, F.lit(0))
    ratio = nd.cast("double") / F.greatest(n_rows, F.lit(1)).cast("double")
    return (F.when(nd <= 1, "constant")
             .when(((nd == n_rows) | (ratio > 0.95)) & id_name, "id")
             .when(is_date, "datetime")
             .when(is_numeric, "numeric")
             .otherwise("categorical"))


def column_stats(df: DataFrame, quantiles: bool = True, moments: bool | None = None) -> DataFrame:
    """Full per-column profile (A1, A3, A5-A12, F1, F2, F4, T1), one row per column.

    Columns: column, ordinal, dtype, semantic_type, n_rows, missing_count, missing_pct,
    n_distinct, count, mean, std, min, q25, median, q75, max, skewness, kurtosis,
    zero_count, outlier_count, outlier_pct, cardinality_ratio, top_value, top_freq,
    top_freq_pct, min_date, max_date.  Numeric fields are filled for numeric
    columns, the top_* fields for categorical ones, dates for datetime ones.
    """
    cols = columns_of(df)
    moments = quantiles if moments is None else moments
    wide = wide_aggregates(df, cols)
    vc = value_counts(df, cols)
    text_names = [c.name for c in cols if c.text]
    dist = distinct_summary(vc, text_names)
    base = wide.join(dist, "column", "left")
    if not text_names:
        base = base.select("*", F.lit(None).cast("long").alias("text_non_null"), F.lit(None).cast("long").alias("date_like"),
                           F.lit(None).cast("long").alias("date_parsed"), F.lit(None).cast("timestamp_ntz").alias("ttmin"),
                           F.lit(None).cast("timestamp_ntz").alias("ttmax"))
    base = base.withColumn("tmin", F.coalesce("tmin", "ttmin")).withColumn("tmax", F.coalesce("tmax", "ttmax"))
    base = base.withColumn("date_candidate", date_candidate(
        F.col("is_temporal"), F.col("is_text"), F.col("text_non_null"), F.col("date_like"), F.col("date_parsed")))
    base = base.withColumn("semantic_type", semantic_type(
        F.col("n_distinct"), F.col("n_rows"), F.col("id_name"), F.col("date_candidate"), F.col("is_numeric")))

    base = base.join(_numeric_part(df, cols, quantiles, moments), "column", "left")
    return _profile_rows(base)


def _numeric_part(df: DataFrame, cols: list[ColumnInfo], quantiles: bool, moments: bool) -> DataFrame:
    """``numeric_summary`` with the columns that aren't asked for left NULL."""
    numeric = [c for c in cols if c.numeric]
    if numeric and (moments or quantiles):
        return numeric_summary(df, numeric, quantiles)
    return df.sparkSession.createDataFrame([], SUMMARY)


def _profile_rows(base: DataFrame) -> DataFrame:
    st = F.col("semantic_type")
    isnum = st == "numeric"
    iscat = st == "categorical"
    isdt = st == "datetime"
    n = F.col("num_count")
    rows = F.greatest(F.col("n_rows"), F.lit(1)).cast("double")  # shares of an empty table are 0

    def num(c: Column, default: float = 0.0) -> Column:
        return F.when(isnum, F.when(n > 0, c).otherwise(F.lit(default)))

    return base.select(
        "column", "ordinal", "dtype", "semantic_type", "n_rows", "missing_count",
        (F.col("missing_count") * 100.0 / rows).alias("missing_pct"),
        F.coalesce(F.col("n_distinct"), F.lit(0)).alias("n_distinct"),
        F.when(isnum, n).when(iscat, F.col("non_null")).alias("count"),
        num(F.col("mean")).alias("mean"),
        F.when(isnum, F.when(n > 1, F.col("std_raw")).otherwise(0.0)).alias("std"),
        num(F.col("min")).alias("min"), num(F.col("q25")).alias("q25"), num(F.col("median")).alias("median"),
        num(F.col("q75")).alias("q75"), num(F.col("max")).alias("max"),
        F.when(isnum, F.coalesce(F.nanvl(X.sample_skewness(n, F.col("g1")), F.lit(0.0)), F.lit(0.0))).alias("skewness"),
        F.when(isnum, F.coalesce(F.nanvl(X.sample_kurtosis(n, F.col("g2")), F.lit(0.0)), F.lit(0.0))).alias("kurtosis"),
        F.when(isnum, F.col("zero_count")).alias("zero_count"),
        F.when(isnum, F.coalesce(F.col("outlier_count"), F.lit(0))).alias("outlier_count"),
        F.when(isnum, F.coalesce(F.col("outlier_count"), F.lit(0)) * 100.0 / rows).alias("outlier_pct"),
        F.when(iscat, F.col("n_distinct") / rows).alias("cardinality_ratio"),
        F.when(iscat, F.col("top_value")).alias("top_value"),
        F.when(iscat, F.coalesce(F.col("top_freq"), F.lit(0))).alias("top_freq"),
        F.when(iscat, F.coalesce(F.col("top_freq"), F.lit(0)) * 100.0 / rows).alias("top_freq_pct"),
        F.when(isdt, X.iso_format(F.col("tmin"))).alias("min_date"),
        F.when(isdt, X.iso_format(F.col("tmax"))).alias("max_date"), "date_candidate",
    )


def _only(df: DataFrame, keep) -> DataFrame:
    """Project the columns that can end up with the wanted semantic type (a column's type depends
    only on its own statistics), so the scan and the unpivot carry nothing else."""
    cols = [c.name for c in columns_of(df) if keep(c)]
    return df.select(*cols) if cols else df.limit(0)


def numeric_profile(df: DataFrame) -> DataFrame:
    """A5, A6, A8-A10 for the columns of numeric type.

    The type rule asks for distinct counts only of columns that are named like ids and whose range has room for
    enough values; the others are not counted."""
    cols = [c for c in columns_of(df) if c.numeric]
    if not cols:
        df = df.select(F.lit(None).cast("double").alias("x")).limit(0)
        cols = columns_of(df)
    base = wide_aggregates(df.select(*[c.name for c in cols]), cols).join(numeric_summary(df, cols), "column", "left")
    room = ~F.col("column").isin([c.name for c in cols if c.integral]) | (F.col("max") - F.col("min") + 1 > 0.95 * F.col("n_rows"))
    near = [r["column"] for r in base.where(F.col("id_name") & room & (F.col("num_count") > 0.95 * F.col("n_rows"))).select("column").collect()]
    named = [c for c in cols if c.name in near]
    if named:
        exact = value_counts(df, named).groupBy("column").agg(F.count(F.lit(1)).alias("n_exact"))
        base = base.join(exact, "column", "left")
    else:
        base = base.withColumn("n_exact", F.lit(None).cast("long"))
    # not counted: only whether there is more than one value matters
    distinct = F.coalesce("n_exact", F.when(F.col("min") == F.col("max"), 1).when(F.col("min").isNotNull(), 2))
    kind = semantic_type(distinct, F.col("n_rows"), F.col("id_name"), F.lit(False), F.lit(True))
    absent = {"non_null": "long", "top_value": "string", "top_freq": "long", "date_candidate": "boolean"}
    rows = _profile_rows(base.withColumns({"n_distinct": distinct, "semantic_type": kind, **{k: F.lit(None).cast(t) for k, t in absent.items()}}))
    return rows.where(F.col("semantic_type") == "numeric").select(
        "column", "count", "mean", "std", "min", "q25", "median", "q75", "max", "skewness", "kurtosis",
        "zero_count", "outlier_count", "outlier_pct", "missing_count", "missing_pct")


def categorical_profile(df: DataFrame) -> DataFrame:
    cs = column_stats(_only(df, lambda c: not c.numeric and not c.temporal), quantiles=False)
    return cs.where(F.col("semantic_type") == "categorical").select(
        "column", "count", F.col("n_distinct").alias("unique_count"), "cardinality_ratio", "top_value",
        "top_freq", "top_freq_pct", "missing_count", "missing_pct")


def datetime_profile(df: DataFrame) -> DataFrame:
    cs = column_stats(_only(df, lambda c: c.temporal or c.text), quantiles=False)
    return cs.where(F.col("semantic_type") == "datetime").select(
        "column", "min_date", "max_date", F.col("n_distinct").alias("unique_dates"), "missing_count")


def top_categories(df: DataFrame, k: int = 10, only: list[str] | None = None) -> DataFrame:
    """K2: top-k values per column by frequency (ties: smallest value first)."""
    cols = [c for c in columns_of(df) if only is None or c.name in only]
    vc = value_counts(df, cols)
    return top_k_per_group(vc.select("column", "value", "count"), ["column"],
                           [F.col("count").desc(), F.col("value")], k)


def missingness(df: DataFrame) -> DataFrame:
    """A3/A4: per-column missing counts plus a '__total__' row over all cells."""
    cols = columns_of(df)
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(X.is_missing(c.name, c.dtype)).alias(f"m{c.ordinal}") for c in cols])
    per = row.select(F.col("__rows"), F.inline(F.array(*[
        F.struct(F.lit(c.name).alias("column"), F.col(f"m{c.ordinal}").cast("long").alias("missing_count"))
        for c in cols])))
    per = per.select("column", "missing_count", (F.col("missing_count") * 100.0 / F.greatest(F.col("__rows"), F.lit(1))).alias("missing_pct"))
    total = row.select(F.lit("__total__").alias("column"),
                       sum((F.col(f"m{c.ordinal}") for c in cols), F.lit(0)).cast("long").alias("missing_count"),
                       (sum((F.col(f"m{c.ordinal}") for c in cols), F.lit(0)) * 100.0 /
                        F.greatest(F.col("__rows") * len(cols), F.lit(1))).alias("missing_pct"))
    return per.unionByName(total)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """A2: occurrences after the first of identical rows (NULLs equal), and their share in %."""
    cols = [F.col(c) for c in df.columns]
    nulls = [c.isNull() for c in cols]  # a hash skips NULLs: their places are hashed too
    # whole rows are compared by two 64-bit hashes, so that no text is a shuffle key
    keys = [F.xxhash64(F.lit(seed), *cols, *nulls).alias(f"_h{seed}") for seed in (1, 2)]
    groups = df.select(*keys).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    n, dup = F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))
    return groups.agg(dup.cast("long").alias("duplicate_rows"), n.cast("long").alias("n_rows")) \
                 .select("duplicate_rows", "n_rows",
                         (F.col("duplicate_rows") * 100.0 / F.greatest(F.col("n_rows"), F.lit(1))).alias("duplicate_pct"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, count) over non-null target values; map-side combined."""
    t = F.col(target)
    return df.where(t.isNotNull()).groupBy(t.cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))


def class_summary(df: DataFrame, target: str) -> DataFrame:
    """One row: n_classes, total, minority class (ties: smallest label), its count and share."""
    cc = class_counts(df, target)
    return cc.agg(F.count(F.lit(1)).alias("n_classes"), F.sum("count").alias("total"),
                  F.min_by(F.struct("count", "class"), F.struct("count", "class")).alias("m")) \
             .select("n_classes", "total", F.col("m.class").alias("minority_class"),
                     F.col("m.count").alias("minority_count"),
                     (F.col("m.count") / F.col("total")).alias("minority_share"))


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Class, count, share (for class-valued targets: one row per class)."""
    cc = class_counts(df, target)
    total = cc.agg(F.sum("count")).scalar()  # scalar subquery, evaluated once
    return cc.select("class", "count", (F.col("count") / total).alias("share"))
