"""Data-quality alerts (D0-D7), target leakage (L0-L5), correlations (A13, A14, K3),
class balance (A15) and the cleaning step (C1, U1, U2, P1, P2).

Alerts and findings are rows; every rule is a select over the long column
statistics or one batched aggregation over the data.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tabsight.functions import exprs as X
from tabsight.operators import stats
from tabsight.session import cut_lineage

# Alert rows: alert_type, column, severity, metric, message, suggested_action.

# Fixed rule thresholds of the audit.
HIGH_MISSING_PCT = 40.0
MODERATE_MISSING_PCT = 5.0
HIGH_CARDINALITY = 100
IMBALANCE_MAX_CLASSES = 10
EXTREME_MINORITY = 0.05
MODERATE_MINORITY = 0.25
DUPLICATE_CRITICAL_PCT = 10.0
IDENTITY_SHARE = 0.999
PAIR_MAX_ABS = 1e-4
PAIR_ZERO_SHARE = 0.999
EXTREME_CORR = 0.999

# Pairs per aggregation when verifying additive/difference rules (larger generated aggregation
# methods get markedly slower per row, so pairs go in moderate batches).
PAIR_BATCH = 16
# Rows of the sample on which pairs are screened.
SCREEN_ROWS = 4096


def quality_alerts(df: DataFrame, target: str | None = None, col_stats: DataFrame | None = None,
                   leaks: DataFrame | None = None) -> DataFrame:
    """Union of the alert rules; ``col_stats`` from ``stats.column_stats`` may be passed in."""
    spark = df.sparkSession
    cs = col_stats if col_stats is not None else stats.column_stats(df, quantiles=False)
    cs = cs.select("column", "ordinal", "dtype", "n_rows", "missing_count", "missing_pct", "n_distinct")
    text_cols = [f.name for f in df.schema.fields if X.is_string_type(f.dataType)]

    pct = F.col("missing_pct")
    miss = cs.where(F.col("missing_count") > 0).select(
        F.when(pct > HIGH_MISSING_PCT, "high_missingness").when(pct > MODERATE_MISSING_PCT, "moderate_missingness")
         .alias("alert_type"),
        "column",
        F.when(pct > HIGH_MISSING_PCT, "critical").otherwise("warning").alias("severity"),
        pct.alias("metric"),
        F.format_string("Column '%s' has %.1f%% missing values (%d/%d).", F.col("column"), pct,
                        F.col("missing_count"), F.col("n_rows")).alias("message"),
        F.when(pct > HIGH_MISSING_PCT, "Drop the column or add an explicit missing-value indicator.")
         .otherwise("Impute: median for numeric, most frequent or 'unknown' for categories.").alias("suggested_action"),
    ).where(F.col("alert_type").isNotNull())

    const = cs.where(F.col("n_distinct") <= 1).select(
        F.lit("constant_feature").alias("alert_type"), "column", F.lit("warning").alias("severity"),
        F.col("n_distinct").cast("double").alias("metric"),
        F.format_string("Column '%s' is constant with %d unique value.", F.col("column"), F.col("n_distinct")).alias("message"),
        F.lit("Remove the feature before training: it carries no variance.").alias("suggested_action"))

    card = cs.where(F.col("column").isin(text_cols) & (F.col("n_distinct") > HIGH_CARDINALITY) &
                    (F.col("n_distinct") < F.col("n_rows"))).select(
        F.lit("high_cardinality").alias("alert_type"), "column", F.lit("warning").alias("severity"),
        F.col("n_distinct").cast("double").alias("metric"),
        F.format_string("Categorical column '%s' has %d unique categories.", F.col("column"), F.col("n_distinct")).alias("message"),
        F.lit("Use frequency or target encoding, or group rare categories.").alias("suggested_action"))

    parts = [miss, const, card]

    if target is not None and target in df.columns:
        summ = stats.class_summary(df, target).select(
            F.col("n_classes").alias("k"), F.struct(F.col("minority_share").alias("share"),
                                                     F.col("minority_class").alias("class")).alias("m"))
        imb = summ.where(F.col("k") <= IMBALANCE_MAX_CLASSES).select(
            F.when(F.col("m.share") < EXTREME_MINORITY, "extreme_target_imbalance")
             .when(F.col("m.share") < MODERATE_MINORITY, "moderate_target_imbalance").alias("alert_type"),
            F.lit(target).alias("column"),
            F.when(F.col("m.share") < EXTREME_MINORITY, "critical").otherwise("warning").alias("severity"),
            F.col("m.share").alias("metric"),
            F.format_string("Minority class '%s' holds %.2f%% of rows.", F.col("m.class"), F.col("m.share") * 100).alias("message"),
            F.lit("Stratify folds, tune the decision threshold, report PR-AUC/ROC-AUC/F1/F2 over accuracy.").alias("suggested_action"),
        ).where(F.col("alert_type").isNotNull())
        parts.append(imb)
        lk = leaks if leaks is not None else leakage_columns(df, target)
        parts.append(lk.select(
            F.lit("target_component_leakage").alias("alert_type"), "column", F.lit("critical").alias("severity"),
            F.lit(None).cast("double").alias("metric"), F.col("explanation").alias("message"),
            F.format_string("Exclude '%s' from the features before training.", F.col("column")).alias("suggested_action")))

    dup = stats.duplicate_rows(df).where(F.col("duplicate_rows") > 0).select(
        F.lit("duplicate_rows").alias("alert_type"), F.lit(None).cast("string").alias("column"),
        F.when(F.col("duplicate_pct") > DUPLICATE_CRITICAL_PCT, "critical").otherwise("info").alias("severity"),
        F.col("duplicate_pct").alias("metric"),
        F.format_string("Dataset contains %d exact duplicate rows (%.1f%%).", F.col("duplicate_rows"),
                        F.col("duplicate_pct")).alias("message"),
        F.lit("Deduplicate before the validation split.").alias("suggested_action"))
    parts.append(dup)

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# Leakage
# ---------------------------------------------------------------------------

def _comparable(a: T.DataType, b: T.DataType) -> bool:
    if X.is_numeric_type(a) and X.is_numeric_type(b):
        return True
    if X.is_string_type(a) and X.is_string_type(b):
        return True
    if X.is_datetime_type(a) and X.is_datetime_type(b):
        return True
    return isinstance(a, T.BooleanType) and isinstance(b, T.BooleanType)


def _pair_exprs(num_cols: list[str], target: str) -> list[tuple[str, str, str, Column]]:
    """(rule, c1, c2, residual) for every additive pair and both difference orders."""
    t = X.as_double(target)
    out = []
    for c1, c2 in itertools.combinations(num_cols, 2):
        a, b = X.as_double(c1), X.as_double(c2)
        out.append(("additive", c1, c2, F.abs(a + b - t)))
        out.append(("difference", c1, c2, F.abs(a - b - t)))
        out.append(("difference", c2, c1, F.abs(b - a - t)))
    return out


def _pair_stats(df: DataFrame, pairs: list[tuple[str, str, str, Column]]) -> list[tuple]:
    """(rule, c1, c2, max_abs, zero_count, n) per pair; batched aggregations over ``df``."""
    res = []
    for i in range(0, len(pairs), PAIR_BATCH):
        batch = pairs[i:i + PAIR_BATCH]
        aggs = [F.count(F.lit(1)).alias("n")]
        for j, (_, _, _, r) in enumerate(batch):
            aggs += [F.max(r).alias(f"m{j}"), F.count_if(r == 0).alias(f"z{j}")]
        row = df.agg(*aggs).first()
        for j, (rule, c1, c2, _) in enumerate(batch):
            res.append((rule, c1, c2, row[f"m{j}"], int(row[f"z{j}"]), int(row["n"])))
    return res


def _possible_pairs(own: DataFrame, target: str, cols: list[str], n: int) -> set[tuple[str, str, str]]:
    """Pairs (rule, c1, c2) that a random sample of SCREEN_ROWS rows leaves possible.

    The rows with the smallest hashes are taken, so one scan serves all pairs.  A residual that is not small in the sample is not
    small in the table.  A residual that is zero on more than PAIR_ZERO_SHARE of all rows has at most a few others in
    the sample; ten times as many as expected rule it out (in a table no larger than the sample, exactly)."""
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in own.columns], F.monotonically_increasing_id())
    sample = own.orderBy(spread).limit(SCREEN_ROWS).toPandas().to_numpy(dtype=float)
    t, a = sample[:, [0]], sample[:, 1:]
    allowed = (1 - PAIR_ZERO_SHARE) * len(sample) if n <= len(sample) else 10 * (1 - PAIR_ZERO_SHARE) * len(sample)
    out = set()
    for i, c1 in enumerate(cols[:-1]):
        rest = a[:, i + 1:]
        for rule, residual, order in (("additive", a[:, [i]] + rest - t, 1), ("difference", a[:, [i]] - rest - t, 1), ("difference", rest - a[:, [i]] - t, -1)):
            size = np.abs(residual)
            large = np.nanmax(np.where(np.isnan(size), -1.0, size), axis=0) >= PAIR_MAX_ABS
            others = (~(size == 0)).sum(axis=0)  # missing values count as not zero
            for j in np.flatnonzero(~(large & (others > allowed))):
                c2 = cols[i + 1 + int(j)]
                out.add((rule, c1, c2) if order == 1 else (rule, c2, c1))
    return out


def leakage_findings(df: DataFrame, target: str) -> DataFrame:
    """All leakage evidence rows: (column, rule, partner, value).

    rules: identity (L1), additive (L2), difference (L3, both orders), correlation (L4), keyword (L5).
    The pair search looks at all pairs on one bounded random sample first; the few that it leaves possible are verified
    on all rows, so the number of scans doesn't depend on the number of columns.
    """
    spark = df.sparkSession
    fields = {f.name: f.dataType for f in df.schema.fields}
    tdt = fields[target]
    others = [c for c in df.columns if c != target]
    rows: list[tuple] = []

    # L1 identity + L4 correlation: one aggregation
    aggs = [F.count(F.lit(1)).alias("__n")]
    ident_cols = [c for c in others if _comparable(fields[c], tdt)]
    for i, c in enumerate(ident_cols):
        aggs.append(F.count_if(F.coalesce(F.col(c) == F.col(target), F.lit(False))).alias(f"e{i}"))
    t_numeric = X.is_numeric_type(tdt)
    num_cols = [c for c in others if X.is_numeric_type(fields[c])] if t_numeric else []
    for i, c in enumerate(num_cols):
        aggs.append(X.safe_corr(X.as_double(c), X.as_double(target)).alias(f"r{i}"))
    row = df.agg(*aggs).first()
    n = int(row["__n"])
    for i, c in enumerate(ident_cols):
        share = row[f"e{i}"] / n if n else 0.0
        if share > IDENTITY_SHARE:
            rows.append((c, "identity", None, float(share)))

    # L2 / L3 pairs: a sample that fits one array rules most of them out, the others are verified on all rows
    if t_numeric and len(num_cols) >= 2:
        own = df.select(*[X.as_double(c).alias(c) for c in [target, *num_cols]])
        possible = _possible_pairs(own, target, num_cols, n)
        pairs = [p for p in _pair_exprs(num_cols, target) if p[:3] in possible]
        for rule, c1, c2, m, z, ns in _pair_stats(own, pairs) if pairs else []:
            if (m is not None and m < PAIR_MAX_ABS) or (ns and z / ns > PAIR_ZERO_SHARE):
                rows.append((c1, rule, c2, float(m) if m is not None else None))
                rows.append((c2, rule, c1, float(m) if m is not None else None))

    for i, c in enumerate(num_cols):
        r = row[f"r{i}"]
        if r is not None and r == r and abs(r) >= EXTREME_CORR:
            rows.append((c, "correlation", None, float(r)))

    rows += [(r["column"], "keyword", None, None) for r in post_outcome_names(spark, others).collect()]  # schema sized

    schema = "column string, rule string, partner string, value double"
    # evidence is at most (#columns)^2 rows: built from the aggregate results, not from data rows
    return spark.createDataFrame(rows, schema)


def post_outcome_names(spark, names: list[str]) -> DataFrame:
    """Columns whose name tells what is known after the outcome only; names with a prefix of history features are fine."""
    cols = spark.createDataFrame([(n,) for n in names], "column string")
    return cols.where(~X.contains_any(F.lower("column"), X.HISTORY_PREFIXES) & X.post_outcome(F.col("column"))).select("column")


_RULE_RANK = {"difference": 1, "additive": 2, "identity": 3, "correlation": 4, "keyword": 5}


def leakage_columns(df: DataFrame, target: str, findings: DataFrame | None = None) -> DataFrame:
    """L0: one row per leaky column with the deciding rule and an explanation, sorted by column."""
    f = findings if findings is not None else leakage_findings(df, target)
    rank = F.create_map(*[x for k, v in _RULE_RANK.items() for x in (F.lit(k), F.lit(v))])
    best = f.groupBy("column").agg(F.min_by(F.struct("rule", "partner", "value"),
                                            F.struct(rank[F.col("rule")], F.col("partner"))).alias("b"))
    t = F.lit(target)
    expl = (F.when(F.col("b.rule") == "identity",
                   F.format_string("Column '%s' is an exact copy of the target '%s'.", F.col("column"), t))
             .when(F.col("b.rule") == "additive",
                   F.format_string("Column '%s' plus '%s' equals the target '%s'.", F.col("column"), F.col("b.partner"), t))
             .when(F.col("b.rule") == "difference",
                   F.format_string("Column '%s' is a deterministic difference component of the target '%s' (with '%s').",
                                   F.col("column"), t, F.col("b.partner")))
             .when(F.col("b.rule") == "correlation",
                   F.format_string("Column '%s' has an extreme correlation (%.4f) with the target '%s'.",
                                   F.col("column"), F.col("b.value"), t))
             .otherwise(F.format_string("Column '%s' holds post-outcome information.", F.col("column"))))
    return best.select("column", F.col("b.rule").alias("reason"), F.col("b.partner").alias("partner"),
                       expl.alias("explanation")).orderBy("column")


# ---------------------------------------------------------------------------
# Correlations
# ---------------------------------------------------------------------------

def second_moments(df: DataFrame, cols: list[str]) -> tuple[list[dict], np.ndarray]:
    """Per column mean, min and max, and the matrix of centred second moments over the rows that are complete in all ``cols``.

    Three scans, whatever the number of columns: sums, extremes, then one matrix product per batch of rows, added up per entry."""
    # one array column, without a filter: Catalyst has nothing to infer about each of many columns
    rows = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"))
    k = len(cols)
    if not cols:
        return [], np.zeros((0, 0))

    def summed(make, how) -> np.ndarray:
        """An array per batch of rows, put together over all batches, entry by entry."""
        def run(batches):
            for b in batches:
                x = np.array([np.asarray(v, dtype=float) for v in b["x"]]).reshape(len(b), k)  # missing values are NaN
                x = x[~np.isnan(x).any(axis=1)]
                if len(x):
                    yield pd.DataFrame({"m": [make(x).ravel().tolist()]})
        found = rows.mapInPandas(run, "m array<double>").select(F.posexplode("m").alias("at", "v")).groupBy("at").agg(how("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(found)])  # at most (#columns)^2 numbers
    first = summed(lambda x: np.concatenate([np.full(k, len(x)), x.sum(axis=0)]), F.sum)
    if not len(first):
        return [{"mean": None, "min": None, "max": None}] * k, np.zeros((k, k))
    ends = summed(lambda x: np.concatenate([x.max(axis=0), -x.min(axis=0)]), F.max)
    high, low = ends[:k], -ends[k:]
    mean = first[k:] / first[:k]
    moments = summed(lambda x: (x - mean).T @ (x - mean), F.sum)
    return [{"mean": float(m), "min": float(a), "max": float(b)} for m, a, b in zip(mean, low, high)], moments.reshape(k, k)


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every pair of ``cols`` over rows complete in all of them (list-wise)."""
    about, m = second_moments(df, cols)
    rows = []
    for i, j in itertools.combinations(range(len(cols)), 2):
        if all(about[k]["mean"] is not None and about[k]["min"] != about[k]["max"] for k in (i, j)):
            rows.append((cols[i], cols[j], float(m[i, j] / np.sqrt(m[i, i] * m[j, j]))))
    # the matrix is (#columns)^2 numbers: built from the aggregate result
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, correlation double")


def top_correlations(pairs: DataFrame, k: int = 10) -> DataFrame:
    """K3: top-k positive and top-k negative pairs by |r| (rank within sign)."""
    sign = F.when(F.col("correlation") > 0, "positive").when(F.col("correlation") < 0, "negative")
    w = Window.partitionBy("sign").orderBy(F.abs("correlation").desc(), "feature_1", "feature_2")
    return (pairs.withColumn("sign", sign).where(F.col("sign").isNotNull())
                 .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def target_correlations(df: DataFrame, target: str, cols: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r of each column with the target (one aggregation)."""
    t = X.as_double(target)
    row = df.agg(*[X.safe_corr(X.as_double(c), t).alias(f"r{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("correlation"))
                                         for i, c in enumerate(cols)])))


# ---------------------------------------------------------------------------
# Cleaning
# ---------------------------------------------------------------------------

def clean_dataset(df: DataFrame, target: str | None = None, drop_columns: list[str] | None = None,
                  leaks: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Distinct rows -> drop leak columns (given + detected) -> drop all-unique id columns.

    Returns the cleaned frame (lazy) and the dropped column names in drop order.
    """
    cleaned = cut_lineage(df.dropDuplicates())  # read by the leak search, the id count and the caller
    leak_set = set(drop_columns or [])
    if target:
        lk = leaks if leaks is not None else leakage_columns(cleaned, target)
        leak_set |= {r["column"] for r in lk.select("column").collect()}  # column names only
    dropped = [c for c in sorted(leak_set) if c in cleaned.columns and c != target]
    cleaned = cleaned.drop(*dropped)
    cands = [c for c in cleaned.columns if c != target and (
        "id" in c.lower() or "key" in c.lower() or c.lower() in X.ID_EXACT_NAMES)]
    if cands:
        cs = stats.value_counts(cleaned, [ci for ci in stats.columns_of(cleaned) if ci.name in cands])
        nd = {r["column"]: r["n"] for r in cs.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = cleaned.count()
        ids = [c for c in cands if nd.get(c, 0) == n]
        cleaned = cleaned.drop(*ids)
        dropped += ids
    return cleaned, dropped
