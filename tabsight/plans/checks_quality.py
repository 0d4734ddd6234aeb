"""Registered audit queries: alerts (D0-D7), leakage (L0-L5), correlations (A13, A14, K3),
class balance (A15, G13), target/task inference (T2-T4), cleaning (C1, U1, P1, P2)."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.functions import exprs as X
from tabsight.operators import classify, quality, stats
from tabsight.plans.sqlgen import SCHEMAS, q, semantic_type_sql
from tabsight.session import cut_lineage, read_table

# ---------------------------------------------------------------------------
# Frames derived from the driver tables
# ---------------------------------------------------------------------------


def leak_frame(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a net-revenue target and its deterministic components."""
    li = read_table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_quantity", F.col("l_extendedprice").alias("list_price"), "l_discount", "l_tax",
        (F.col("l_extendedprice") * F.col("l_discount")).alias("discount_amount"),
        (F.col("l_quantity") * 2).alias("post_sale_units"), "l_returnflag",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_revenue"))


LEAK_FRAME_SQL = ("(SELECT l_orderkey, l_quantity, l_extendedprice AS list_price, l_discount, l_tax, "
                  "l_extendedprice * l_discount AS discount_amount, l_quantity * 2 AS post_sale_units, l_returnflag, "
                  "l_extendedprice * (1 - l_discount) AS net_revenue FROM lineitem)")
LEAK_NUMERIC = ["l_orderkey", "l_quantity", "list_price", "l_discount", "l_tax", "discount_amount", "post_sale_units"]
LEAK_ALL = LEAK_NUMERIC[:6] + ["post_sale_units", "l_returnflag"]


def audit_frame(spark: SparkSession, sf: str) -> DataFrame:
    """documents (content columns) left-joined to their labels."""
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select("text", "lang", "source", "n_chars", "quality", "toxic")


AUDIT_FRAME_SQL = ("(SELECT d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d "
                   "LEFT JOIN labels l ON d.doc_id = l.doc_id)")
AUDIT_COLS = [("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "n"), ("quality", "n"), ("toxic", "n")]


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def leakage_findings(spark: SparkSession, sf: str) -> DataFrame:
    return quality.leakage_findings(leak_frame(spark, sf), "net_revenue")


def leakage_columns(spark: SparkSession, sf: str) -> DataFrame:
    return quality.leakage_columns(leak_frame(spark, sf), "net_revenue").select("column", "reason", "partner")


def quality_alerts(spark: SparkSession, sf: str) -> DataFrame:
    a = quality.quality_alerts(audit_frame(spark, sf), target="toxic")
    return a.select("alert_type", "column", "severity", "metric")


def leak_rules_frame(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a target that is a sum, a difference, a copy and a near copy of other columns."""
    li = read_table(spark, sf, "lineitem")
    t = F.col("l_quantity") + F.col("l_linenumber")
    return li.select(F.col("l_quantity").alias("units"), F.col("l_linenumber").alias("line"), (t + F.col("l_tax")).alias("gross"), "l_tax", "l_discount",
                     t.alias("copied"), (t + F.col("l_discount") / 10).alias("near"), "l_returnflag", t.alias("score"))


RULES_SQL = ("(SELECT l_quantity AS units, l_linenumber AS line, l_quantity + l_linenumber + l_tax AS gross, l_tax, l_discount, l_quantity + l_linenumber AS copied, "
             "l_quantity + l_linenumber + l_discount / 10 AS near, l_returnflag, l_quantity + l_linenumber AS score FROM lineitem)")
RULES_NUMERIC = ["units", "line", "gross", "l_tax", "l_discount", "copied", "near"]


def leak_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.leakage_findings(leak_rules_frame(spark, sf), "score").select("column", "rule", "partner")


def _leak_rules_oracle() -> str:
    """Every rule on every column and pair."""
    import itertools
    parts = [f"SELECT '{c}' AS \"column\", 'identity' AS rule, NULL AS partner, avg(CASE WHEN {c} = score THEN 1.0 ELSE 0 END) > 0.999 AS hit FROM f" for c in RULES_NUMERIC]
    parts += [f"SELECT '{c}', 'correlation', NULL, abs(corr({c}, score)) >= 0.999 FROM f" for c in RULES_NUMERIC]
    for a, b in itertools.permutations(RULES_NUMERIC, 2):
        for rule, r in (("additive", f"{a} + {b} - score"), ("difference", f"{a} - {b} - score")):
            hit = f"max(abs({r})) < 1e-4 OR avg(CASE WHEN {r} = 0 THEN 1.0 ELSE 0 END) > 0.999"
            parts.append(f"SELECT '{a}', '{rule}', '{b}', {hit} FROM f")
            if rule == "difference":
                parts.append(f"SELECT '{b}', '{rule}', '{a}', {hit} FROM f")
    return f"WITH f AS {RULES_SQL} SELECT \"column\", rule, partner FROM ({' UNION ALL '.join(parts)}) WHERE hit"


WIDE = 64


def correlation_wide(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of the embeddings' components."""
    e = read_table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i:02d}") for i in range(WIDE)])
    return quality.top_correlations(quality.correlation_pairs(e, e.columns), 10)


def _corr_wide_oracle() -> str:
    return f"""WITH v AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, unnest(range(0, {WIDE})) AS t(i)),
  c AS (SELECT 'e' || lpad(CAST(a.i AS VARCHAR), 2, '0') AS feature_1, 'e' || lpad(CAST(b.i AS VARCHAR), 2, '0') AS feature_2, corr(a.x, b.x) AS correlation
    FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i),
  s AS (SELECT *, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS sign FROM c WHERE correlation <> 0)
SELECT feature_1, feature_2, correlation, sign, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sign ORDER BY abs(correlation) DESC, feature_1, feature_2) AS INTEGER) AS rank FROM s) WHERE rank <= 10"""


def flawed_frame(spark: SparkSession, sf: str) -> DataFrame:
    """customer with a column for every alert: missing cells of both degrees, a constant, names, a rare class, repeated rows."""
    c = read_table(spark, sf, "customer").select(
        "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("half"), F.when(F.col("c_custkey") % 10 > 0, F.col("c_nationkey")).alias("most"),
        F.lit("same").alias("fixed"), (F.col("c_custkey") % 40 == 0).cast("int").alias("rare"))
    return c.unionByName(c.where("most % 5 = 0"))


FLAWED_SQL = """(WITH c AS (SELECT c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS half, CASE WHEN c_custkey % 10 > 0 THEN c_nationkey END AS most,
  'same' AS fixed, CASE WHEN c_custkey % 40 = 0 THEN 1 ELSE 0 END AS rare FROM customer) FROM c UNION ALL FROM c WHERE most % 5 = 0)"""


def alerts_flawed(spark: SparkSession, sf: str) -> DataFrame:
    """D0-D6 with rows that meet each rule's stronger branch."""
    return quality.quality_alerts(flawed_frame(spark, sf), target="rare").select("alert_type", "column", "severity", "metric")


def _alerts_flawed_oracle() -> str:
    cols = ["c_name", "c_mktsegment", "half", "most", "fixed", "rare"]
    parts = []
    for c in cols:
        pct = f"(100.0 * count(*) FILTER ({c} IS NULL) / count(*))"
        parts.append(f"SELECT CASE WHEN {pct} > 40 THEN 'high_missingness' ELSE 'moderate_missingness' END AS alert_type, '{c}' AS \"column\", "
                     f"CASE WHEN {pct} > 40 THEN 'critical' ELSE 'warning' END AS severity, {pct} AS metric, {pct} > 5 AS hit FROM f")
        parts.append(f"SELECT 'constant_feature', '{c}', 'warning', CAST(count(DISTINCT {c}) AS DOUBLE), count(DISTINCT {c}) <= 1 FROM f")
    for c in ("c_name", "c_mktsegment", "fixed"):
        parts.append(f"SELECT 'high_cardinality', '{c}', 'warning', CAST(count(DISTINCT {c}) AS DOUBLE), count(DISTINCT {c}) > 100 AND count(DISTINCT {c}) < count(*) FROM f")
    parts.append("SELECT CASE WHEN s < 0.05 THEN 'extreme_target_imbalance' ELSE 'moderate_target_imbalance' END, 'rare', CASE WHEN s < 0.05 THEN 'critical' ELSE 'warning' END, s, s < 0.25 "
                 "FROM (SELECT min(n) / sum(n) AS s FROM (SELECT count(*) AS n FROM f GROUP BY rare))")
    parts.append("SELECT 'duplicate_rows', NULL, CASE WHEN p > 10 THEN 'critical' ELSE 'info' END, p, p > 0 FROM (SELECT 100.0 * sum(n - 1) / sum(n) AS p FROM "
                 f"(SELECT count(*) AS n FROM f GROUP BY {', '.join(cols)}))")
    return f"WITH f AS {FLAWED_SQL} SELECT alert_type, \"column\", severity, metric FROM ({' UNION ALL '.join(parts)}) WHERE hit"


def correlation_top(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    cols = [c for c, k in SCHEMAS["lineitem"] if k == "n"]
    return quality.top_correlations(quality.correlation_pairs(li, cols), 10)


def target_correlation(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem")
    cols = [c for c, k in SCHEMAS["lineitem"] if k == "n" and c != "l_extendedprice"]
    return quality.target_correlations(li, "l_extendedprice", cols)


def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    lab = read_table(spark, sf, "labels")
    parts = [
        stats.class_distribution(lab, "toxic").withColumn("target", F.lit("labels.toxic")),
        stats.class_distribution(lab, "quality").withColumn("target", F.lit("labels.quality")),
        stats.class_distribution(read_table(spark, sf, "customer"), "c_mktsegment").withColumn("target", F.lit("customer.c_mktsegment")),
        stats.class_distribution(read_table(spark, sf, "embeddings"), "label").withColumn("target", F.lit("embeddings.label")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TASK_CASES = [
    # (case name, table, target, time, goal)
    ("labels_auto", "labels", None, None, ""),
    ("customer_segment", "customer", "c_mktsegment", None, ""),
    ("orders_price", "orders", "o_totalprice", None, ""),
    ("orders_forecast", "orders", "o_totalprice", None, "forecast the next quarter"),
    ("embeddings_label", "embeddings", None, None, ""),
    ("embeddings_label_goal", "embeddings", "label", None, "multiclass classification of vectors"),
    ("part_explore", "part", None, None, "explore and profile the data"),
]


def task_decision(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    col_stats: dict[str, DataFrame] = {}  # one column-statistics pass per table, shared by its cases
    for name, table, target, time, goal in TASK_CASES:
        df = read_table(spark, sf, table)
        if table not in col_stats:
            col_stats[table] = cut_lineage(stats.column_stats(df, quantiles=False).select("column", "ordinal", "semantic_type", "date_candidate"))
        d = classify.decide_task(df, target, time, goal, col_stats=col_stats[table]).withColumn("case_name", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


PREVIEW_TABLES = ["labels", "customer", "orders", "embeddings", "part", "events"]


def target_candidates(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t in PREVIEW_TABLES:
        df = read_table(spark, sf, t)
        cs = cut_lineage(stats.column_stats(df, quantiles=False))
        pv = classify.profile_preview(df, cs).select("inferred_problem_type")
        part = classify.candidate_targets(cs.select("column", "ordinal", "semantic_type")).withColumn("table_name", F.lit(t))
        part = part.unionByName(pv.select(F.lit("__task__").alias("column"), F.lit(0).alias("rank"),
                                          F.col("inferred_problem_type").alias("rule"), F.lit(t).alias("table_name")))
        out = part if out is None else out.unionByName(part)
    return out


def clean_summary(spark: SparkSession, sf: str) -> DataFrame:
    """C1 on the leak frame: per column the action taken (dropped_leak / dropped_id / kept),
    with row counts before and after de-duplication."""
    lf = leak_frame(spark, sf)
    distinct = cut_lineage(lf.dropDuplicates())
    found = cut_lineage(quality.leakage_columns(distinct, "net_revenue"))
    cleaned, dropped = quality.clean_dataset(distinct, target="net_revenue", leaks=found)
    leaks = set(r["column"] for r in found.collect())
    before, after = lf.count(), cleaned.count()
    rows = []
    for c in lf.columns:
        action = "kept" if c in cleaned.columns else ("dropped_leak" if c in leaks else "dropped_id")
        rows.append((c, action, before, after))
    # one row per column of the frame (schema-sized)
    return spark.createDataFrame(rows, "column_name string, action string, rows_before long, rows_after long")


# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

def _leak_oracle() -> str:
    src = LEAK_FRAME_SQL
    t = "CAST(net_revenue AS DOUBLE)"
    parts = []
    for c in LEAK_NUMERIC:
        parts.append(f"SELECT {q(c)} AS \"column\", 'identity' AS rule, NULL::VARCHAR AS partner, "
                     f"count_if(coalesce(CAST({c} AS DOUBLE) = {t}, false)) / count(*)::DOUBLE AS value FROM {src} "
                     f"HAVING count_if(coalesce(CAST({c} AS DOUBLE) = {t}, false)) / count(*)::DOUBLE > 0.999")
    for c1, c2 in itertools.combinations(LEAK_NUMERIC, 2):
        a, b = f"CAST({c1} AS DOUBLE)", f"CAST({c2} AS DOUBLE)"
        for rule, x, y, r in [("additive", c1, c2, f"abs({a} + {b} - {t})"), ("difference", c1, c2, f"abs({a} - {b} - {t})"),
                              ("difference", c2, c1, f"abs({b} - {a} - {t})")]:
            cond = f"max({r}) < 1e-4 OR count_if({r} = 0) / count(*)::DOUBLE > 0.999"
            for col, partner in [(x, y), (y, x)]:
                parts.append(f"SELECT {q(col)}, {q(rule)}, {q(partner)}, max({r}) FROM {src} HAVING {cond}")
    for c in LEAK_NUMERIC:
        parts.append(f"SELECT {q(c)}, 'correlation', NULL, corr(CAST({c} AS DOUBLE), {t}) FROM {src} "
                     f"HAVING abs(corr(CAST({c} AS DOUBLE), {t})) >= 0.999")
    words = X.POST_OUTCOME_KEYWORDS
    held = " OR ".join(f"contains(lower(column_name), {q(w)})" for w in words)
    stems = " OR ".join(f"contains(lower(column_name), {q(w)})" for w in X.HISTORY_STEMS)
    prefixes = " OR ".join(f"contains(lower(column_name), {q(w)})" for w in X.HISTORY_PREFIXES)
    parts.append(f"""SELECT column_name, 'keyword', NULL, NULL FROM (DESCRIBE SELECT * FROM {src}) WHERE column_name <> 'net_revenue' AND NOT ({prefixes})
      AND (lower(column_name) IN ({', '.join(map(q, words))}) OR (({held}) AND NOT ({stems})))""")
    return " UNION ALL ".join(parts)


def _leak_columns_oracle() -> str:
    return f"""SELECT "column", arg_min(rule, rk * 1000 + coalesce(pr, 0)) AS reason,
  arg_min(partner, rk * 1000 + coalesce(pr, 0)) AS partner FROM (
  SELECT *, CASE rule WHEN 'difference' THEN 1 WHEN 'additive' THEN 2 WHEN 'identity' THEN 3
    WHEN 'correlation' THEN 4 ELSE 5 END AS rk,
    dense_rank() OVER (PARTITION BY "column", rule ORDER BY partner) AS pr
  FROM ({_leak_oracle()}) f) g GROUP BY "column" """


def _alerts_oracle() -> str:
    src = AUDIT_FRAME_SQL
    parts = []
    for c, _ in AUDIT_COLS:
        pct = f"(count(*) - count({c})) * 100.0 / count(*)"
        parts.append(f"SELECT CASE WHEN {pct} > 40.0 THEN 'high_missingness' ELSE 'moderate_missingness' END AS alert_type, "
                     f"{q(c)} AS \"column\", CASE WHEN {pct} > 40.0 THEN 'critical' ELSE 'warning' END AS severity, "
                     f"{pct} AS metric FROM {src} HAVING count(*) > count({c}) AND {pct} > 5.0")
        parts.append(f"SELECT 'constant_feature', {q(c)}, 'warning', count(DISTINCT {c})::DOUBLE FROM {src} "
                     f"HAVING count(DISTINCT {c}) <= 1")
    for c, k in AUDIT_COLS:
        if k == "s":
            parts.append(f"SELECT 'high_cardinality', {q(c)}, 'warning', count(DISTINCT {c})::DOUBLE FROM {src} "
                         f"HAVING count(DISTINCT {c}) > 100 AND count(DISTINCT {c}) < count(*)")
    parts.append(f"""SELECT CASE WHEN m < 0.05 THEN 'extreme_target_imbalance' ELSE 'moderate_target_imbalance' END,
  'toxic', CASE WHEN m < 0.05 THEN 'critical' ELSE 'warning' END, m FROM (
  SELECT count(*) AS k, min(n) / sum(n)::DOUBLE AS m FROM (SELECT toxic, count(*) AS n FROM {src}
  WHERE toxic IS NOT NULL GROUP BY toxic)) WHERE k <= 10 AND m < 0.25""")
    cl = ", ".join(c for c, _ in AUDIT_COLS)
    parts.append(f"""SELECT 'duplicate_rows', NULL, CASE WHEN p > 10.0 THEN 'critical' ELSE 'info' END, p FROM (
  SELECT sum(n - 1) AS d, sum(n - 1) * 100.0 / sum(n) AS p FROM (SELECT count(*) AS n FROM {src} GROUP BY {cl})) WHERE d > 0""")
    return " UNION ALL ".join(parts)


def _corr_pairs_sql(table: str, cols: list[str]) -> str:
    src = f"(SELECT * FROM {table} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cols) + ")"
    return " UNION ALL ".join(
        f"SELECT {q(a)} AS feature_1, {q(b)} AS feature_2, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS correlation FROM {src}"
        for a, b in itertools.combinations(cols, 2))


def _corr_top_oracle() -> str:
    cols = [c for c, k in SCHEMAS["lineitem"] if k == "n"]
    return f"""SELECT feature_1, feature_2, correlation, sign, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY sign ORDER BY abs(correlation) DESC, feature_1, feature_2) AS rank FROM (
    SELECT *, CASE WHEN correlation > 0 THEN 'positive' WHEN correlation < 0 THEN 'negative' END AS sign
    FROM ({_corr_pairs_sql('lineitem', cols)}) p WHERE correlation IS NOT NULL AND NOT isnan(correlation)) s
  WHERE sign IS NOT NULL) r WHERE rank <= 10"""


def _target_corr_oracle() -> str:
    cols = [c for c, k in SCHEMAS["lineitem"] if k == "n" and c != "l_extendedprice"]
    return " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", corr(CAST({c} AS DOUBLE), l_extendedprice) AS correlation FROM lineitem" for c in cols)


def _class_balance_oracle() -> str:
    parts = []
    for table, col in [("labels", "toxic"), ("labels", "quality"), ("customer", "c_mktsegment"), ("embeddings", "label")]:
        parts.append(f"SELECT CAST({col} AS VARCHAR) AS class, CAST(count(*) AS BIGINT) AS count, "
                     f"count(*) / sum(count(*)) OVER () AS share, '{table}.{col}' AS target FROM {table} "
                     f"WHERE {col} IS NOT NULL GROUP BY {col}")
    return " UNION ALL ".join(parts)


def _task_oracle() -> str:
    # resolved (target, time) per case follow the same name rules as the Spark side
    resolved = {
        "labels_auto": ("labels", "toxic", None, True, False, False, False),
        "customer_segment": ("customer", "c_mktsegment", None, False, False, False, False),
        "orders_price": ("orders", "o_totalprice", "o_orderdate", True, False, False, False),
        "orders_forecast": ("orders", "o_totalprice", "o_orderdate", True, True, False, False),
        "embeddings_label": ("embeddings", "label", None, True, False, False, False),
        "embeddings_label_goal": ("embeddings", "label", None, True, False, True, False),
        "part_explore": ("part", "p_retailprice", None, True, False, False, True),
    }
    parts = []
    for name, (table, tgt, tcol, num, wf, wc, eda) in resolved.items():
        tc = q(tcol) if tcol else "NULL"
        if eda:
            parts.append(f"SELECT 'eda' AS problem_type, 'exploratory_data_analysis' AS sub_type, {q(tgt)} AS target_column, "
                         f"{tc}::VARCHAR AS time_column, NULL::BIGINT AS n_classes, NULL::DOUBLE AS minority_share, "
                         f"'none' AS recommended_metric, 'none' AS recommended_validation, {q(name)} AS case_name")
            continue
        if tcol and wf:
            parts.append(f"SELECT 'forecasting' AS problem_type, 'time_series_forecasting' AS sub_type, "
                         f"{q(tgt)} AS target_column, {tc}::VARCHAR AS time_column, NULL::BIGINT AS n_classes, "
                         f"NULL::DOUBLE AS minority_share, 'wape' AS recommended_metric, "
                         f"'walk_forward_time_split' AS recommended_validation, {q(name)} AS case_name")
            continue
        nm = "TRUE" if num else "FALSE"
        wcl = "TRUE" if wc else "FALSE"
        bos = f"(k = 2 OR (k <= 5 AND NOT {nm}))"
        smm = f"(k > 2 AND k <= 20 AND (NOT {nm} OR {wcl}))"
        reg = f"({nm} AND k > 20)"
        parts.append(f"""SELECT CASE WHEN {bos} OR {smm} THEN 'classification' WHEN {reg} THEN 'regression' ELSE 'classification' END AS problem_type,
  CASE WHEN {bos} THEN CASE WHEN k = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END
       WHEN {smm} THEN 'multiclass_classification' WHEN {reg} THEN 'tabular_regression'
       WHEN k > 2 THEN 'multiclass_classification' ELSE 'binary_classification' END AS sub_type,
  {q(tgt)} AS target_column, {tc}::VARCHAR AS time_column, k AS n_classes, CASE WHEN {bos} THEN m END AS minority_share,
  CASE WHEN {bos} THEN CASE WHEN k = 2 AND m < 0.25 THEN CASE WHEN m < 0.15 THEN 'pr_auc' ELSE 'roc_auc' END
                            WHEN k = 2 THEN 'roc_auc' ELSE 'f1_macro' END
       WHEN {smm} THEN 'f1_macro' WHEN {reg} THEN 'rmse' WHEN k > 2 THEN 'f1_macro' ELSE 'roc_auc' END AS recommended_metric,
  CASE WHEN {reg} THEN 'kfold' ELSE 'stratified_kfold' END AS recommended_validation, {q(name)} AS case_name
FROM (SELECT CAST(count(*) AS BIGINT) AS k, min(n) / sum(n)::DOUBLE AS m FROM
      (SELECT count(*) AS n FROM {table} WHERE {tgt} IS NOT NULL GROUP BY {tgt}))""")
    return " UNION ALL ".join(parts)


def _candidates_oracle() -> str:
    # name rules are schema-only; the last-column rule needs the column's semantic type, the task
    # preview needs date columns and the first candidate's type / distinct count
    spec = {
        "labels": ([], "toxic", "n", "toxic"),
        "customer": ([], "c_mktsegment", "s", "c_mktsegment"),
        "orders": ([], "o_orderpriority", "s", "o_orderpriority"),
        "embeddings": ([("label", "priority_name")], "label", "n", "label"),
        "part": ([], "p_retailprice", "n", "p_retailprice"),
        "events": ([], "props", "s", "props"),
    }
    parts = []
    for t, (named, last, kind, first) in spec.items():
        for i, (c, rule) in enumerate(named):
            parts.append(f"SELECT {q(c)} AS \"column\", {i + 1} AS rank, {q(rule)} AS rule, {q(t)} AS table_name")
        if last not in [c for c, _ in named]:
            parts.append(f"SELECT {q(last)} AS \"column\", {len(named) + 1} AS rank, 'last_column' AS rule, {q(t)} AS table_name "
                         f"WHERE {semantic_type_sql(t, last, kind)} <> 'id'")
        has_dt = " OR ".join(f"{semantic_type_sql(t, c, k)} = 'datetime'" for c, k in SCHEMAS.get(t, []) if k in "ts") or "FALSE"
        if t == "embeddings":
            has_dt = "FALSE"
        fk = [k for c, k in SCHEMAS.get(t, [(first, kind)]) if c == first][0] if t in SCHEMAS else kind
        parts.append(f"SELECT '__task__', 0, CASE WHEN {has_dt} THEN 'forecasting' "
                     f"WHEN {semantic_type_sql(t, first, fk)} = 'categorical' OR (SELECT count(DISTINCT {first}) FROM {t}) <= 10 "
                     f"THEN 'classification' ELSE 'regression' END, {q(t)}")
    return " UNION ALL ".join(parts)


def _clean_oracle() -> str:
    cols = ["l_orderkey", "l_quantity", "list_price", "l_discount", "l_tax", "discount_amount", "post_sale_units",
            "l_returnflag", "net_revenue"]
    parts = []
    for c in cols:
        idlike = "TRUE" if ("id" in c.lower() or "key" in c.lower()) and c != "net_revenue" else "FALSE"
        parts.append(f"""SELECT {q(c)} AS column_name, CASE
  WHEN {q(c)} IN (SELECT "column" FROM leaks) AND {q(c)} <> 'net_revenue' THEN 'dropped_leak'
  WHEN {idlike} AND (SELECT count(DISTINCT {c}) FROM d) = (SELECT count(*) FROM d) THEN 'dropped_id'
  ELSE 'kept' END AS action, (SELECT count(*) FROM lineitem) AS rows_before, (SELECT count(*) FROM d) AS rows_after""")
    return (f"WITH d AS (SELECT DISTINCT * FROM {LEAK_FRAME_SQL}), leaks AS (SELECT DISTINCT \"column\" FROM "
            f"({_leak_oracle()}) f) " + " UNION ALL ".join(parts))


def goal_intents(spark: SparkSession, sf: str) -> DataFrame:
    """F6 over whole message texts: intent flags per message, counted per role."""
    c = read_table(spark, sf, "conversations")
    flags = classify.goal_flag_columns(F.col("text"))
    return c.select("role", *[v.alias(k) for k, v in flags.items()]).groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(k).cast("long")).alias(k) for k in flags])


QUERIES = {
    "leak_rules": leak_rules,
    "correlation_wide": correlation_wide,
    "alerts_flawed": alerts_flawed,
    "goal_intents": goal_intents,
    "leakage_findings": leakage_findings,
    "leakage_columns": leakage_columns,
    "quality_alerts": quality_alerts,
    "correlation_top": correlation_top,
    "target_correlation": target_correlation,
    "class_balance": class_balance,
    "task_decision": task_decision,
    "target_candidates": target_candidates,
    "clean_summary": clean_summary,
}


def oracle() -> dict[str, str]:
    from tabsight.functions import exprs as X

    def anyw(words):
        return "(" + " OR ".join(f"contains(lower(text), {q(w)})" for w in words) + ")"
    intents = {"wants_forecast": X.GOAL_FORECAST, "wants_classify": X.GOAL_CLASSIFY, "wants_regression": X.GOAL_REGRESSION,
               "wants_eda": X.GOAL_EDA, "marketing_goal": X.GOAL_MARKETING}
    gi = ("SELECT role, CAST(count(*) AS BIGINT) AS n, " +
          ", ".join(f"CAST(sum(CAST({anyw(w)} AS BIGINT)) AS BIGINT) AS {k}" for k, w in intents.items()) +
          " FROM conversations GROUP BY role")
    return {
        "leak_rules": _leak_rules_oracle(),
        "correlation_wide": _corr_wide_oracle(),
        "alerts_flawed": _alerts_flawed_oracle(),
        "goal_intents": gi,
        "leakage_findings": _leak_oracle(),
        "leakage_columns": _leak_columns_oracle(),
        "quality_alerts": _alerts_oracle(),
        "correlation_top": _corr_top_oracle(),
        "target_correlation": _target_corr_oracle(),
        "class_balance": _class_balance_oracle(),
        "task_decision": _task_oracle(),
        "target_candidates": _candidates_oracle(),
        "clean_summary": _clean_oracle(),
    }
