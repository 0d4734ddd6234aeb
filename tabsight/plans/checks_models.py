"""Registered model-stage queries (SURVEY §2.11 M0-M12, §2.13 I1-I3, §2.14 R0-R10, §2.15 G1/G5, §2.16 Z2-Z4,
S9 streaming registration).  Model fits have no SQL twin: the driver checks them rows-only and
tests/ checks them against closed forms and invariants."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.operators import critic, explain, treeshap
from tabsight.plans import analysis
from tabsight.plans.checks_catalog import TABLES
from tabsight.session import checkpoint_dir, read_table, table_path
from tabsight.streaming import ingest

_RUNS: dict = {}


def _labeled_docs(spark, sf) -> DataFrame:
    return read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id").select(
        "lang", "source", "n_chars", "quality", "toxic")


def _run(spark: SparkSession, sf: str, name: str):
    key = (sf, name, id(spark))
    if key not in _RUNS:
        if name == "toxic":
            _RUNS[key] = analysis.run_analysis(spark, _labeled_docs(spark, sf), "classify toxic documents", "toxic")
        elif name == "segment":
            c = read_table(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
            _RUNS[key] = analysis.run_analysis(spark, c, "classify customer segment", "c_mktsegment",
                                               candidates=["LogisticRegression", "RandomForest", "Baseline"])
        elif name == "price":
            o = read_table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
            li = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
                F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"),
                F.avg("l_discount").alias("avg_discount"))
            o2 = read_table(spark, sf, "orders").join(li, "o_orderkey").select(
                "o_orderstatus", "o_orderpriority", "n_lines", "quantity", "avg_discount", "o_totalprice")
            _RUNS[key] = analysis.run_analysis(spark, o2, "predict order price", "o_totalprice",
                                               candidates=["Ridge", "RandomForest", "Baseline"])
    return _RUNS[key]


def model_leaderboard(spark, sf):
    r = _run(spark, sf, "toxic")
    return r.leaderboard.select("model_name", "model_family", "family_label", "cv_mean", "cv_std", "rank", "is_champion")


def holdout_metrics(spark, sf):
    return _run(spark, sf, "toxic").holdout


def critic_status(spark, sf):
    r = _run(spark, sf, "toxic")
    return r.status.join(r.findings.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n_findings")),
                         "experiment_id", "left")


def feature_importance(spark, sf):
    return _run(spark, sf, "toxic").importance


def insight_pillars(spark, sf):
    return _run(spark, sf, "toxic").insights


def multiclass_leaderboard(spark, sf):
    r = _run(spark, sf, "segment")
    return r.leaderboard.select("model_name", "cv_mean", "cv_std", "rank", "is_champion")


def regression_holdout(spark, sf):
    r = _run(spark, sf, "price")
    return r.holdout


def linear_shap(spark, sf):
    r = _run(spark, sf, "price")
    exp = [e for e in r.extra["experiments"] if e.preset == "ridge"][0]
    feats = exp.preprocessor.transform(_price_train(spark, sf, exp))
    w = [float(x) for x in exp.model.stages[0].coefficients.toArray()]
    return explain.linear_shap(feats, w, exp.preprocessor.feature_names)


def _price_train(spark, sf, exp):
    li = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("avg_discount"))
    return read_table(spark, sf, "orders").join(li, "o_orderkey").select(
        "o_orderstatus", "o_orderpriority", F.col("n_lines").cast("double").alias("n_lines"), "quantity", "avg_discount")


def critic_on_scores(spark, sf):
    """R0-R10 over experiments whose metrics come from the deterministic lineitem scorers."""
    from tabsight.plans.checks_metrics import scored_lineitem
    from tabsight.operators import metrics as M
    s = scored_lineitem(spark, sf)
    leaky = read_table(spark, sf, "lineitem").select(
        F.lit("units_score").alias("model"), "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.floor(100 / (1 + F.exp(-(F.col("l_quantity") * 2 - 50) / 20))) / 100).alias("p"))
    s = s.unionByName(leaky)
    from tabsight.functions import exprs as X
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    s = s.withColumn("is_test", (X.hash_rank_key(key) % 5) == 0)
    rk_tr = M.ranking_metrics(s.where(~F.col("is_test")), "y", "p", ["model"])
    rk_te = M.ranking_metrics(s.where(F.col("is_test")), "y", "p", ["model"])
    pr = s.withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    cm_te = M.classification_metrics(pr.where(F.col("is_test")), "y", "pred", ["model"], "1")
    tr = rk_tr.select("model", F.create_map(F.lit("roc_auc"), "roc_auc").alias("train"))
    te = rk_te.join(cm_te, "model").select("model", F.create_map(
        F.lit("roc_auc"), F.col("roc_auc"), F.lit("brier_score"), F.col("brier_score"), F.lit("is_binary"), F.lit(1.0),
        F.lit("is_imbalanced"), F.col("is_imbalanced").cast("double"), F.lit("prevalence"), F.col("prevalence"),
        F.lit("accuracy"), F.col("accuracy"), F.lit("recall_positive"), F.col("recall_positive")).alias("test"))
    feats = F.when(F.col("model") == "qty_score", F.array(F.lit("l_quantity"))) \
        .when(F.col("model") == "disc_score", F.array(F.lit("l_discount"), F.lit("l_tax"))) \
        .otherwise(F.array(F.lit("post_sale_units")))
    exps = tr.join(te, "model").select(
        F.col("model").alias("experiment_id"), F.col("model").alias("model_name"), F.lit("classification").alias("problem_type"),
        F.lit("stratified_kfold").alias("validation_strategy"), F.lit("l_returnflag").alias("target_column"),
        F.lit(None).cast("double").alias("cv_mean"), F.lit(None).cast("double").alias("cv_rmse"), "train", "test",
        feats.alias("feature_names"),
        F.array(*[F.lit(c) for c in ["l_quantity", "l_discount", "l_tax", "post_sale_units", "l_returnflag"]]).alias("raw_columns"),
        F.array().cast("array<string>").alias("remediated"))
    f = critic.critique(exps)
    st = critic.audit_status(exps, f)
    return f.select("experiment_id", "issue_type", "severity", F.array_join("affected_components", ",").alias("affected"),
                    "action").join(st.select("experiment_id", "audit_status"), "experiment_id")


def stream_registration(spark, sf):
    """S9 as a stream: every driver table file is registered once (checksum anti join, exactly once)."""
    base = checkpoint_dir(spark).rstrip("/") + f"/registration-{uuid.uuid4().hex}"
    q = ingest.start_registration(spark, sf, base + "/datasets", base + "/_stream", "*.parquet", once=True)
    q.awaitTermination()
    return spark.read.parquet(base + "/datasets").select("name", "file_type", "row_count", "col_count")


#: A tree over quantity (0), discount (1) and tax (2): node -> (feature, threshold, left, right); the other nodes are leaves.
PRICE_TREE = {0: (0, 25.0, 1, 2), 1: (1, 0.05, 3, 4), 2: (2, 0.04, 5, 6), 5: (0, 40.0, 7, 8)}
PRICE_FEATURES = ("l_quantity", "l_discount", "l_tax")


def _paths(node: int = 0, conditions: tuple[str, ...] = ()) -> dict[int, str]:
    """The condition under which a row reaches each node."""
    out = {node: " AND ".join(conditions) or "true"}
    if node in PRICE_TREE:
        f, t, left, right = PRICE_TREE[node]
        out |= _paths(left, (*conditions, f"{PRICE_FEATURES[f]} <= {t}")) | _paths(right, (*conditions, f"{PRICE_FEATURES[f]} > {t}"))
    return out


def tree_shap(spark, sf):
    """I2 for trees: attributions of a tree whose covers and leaf values (mean prices) come from lineitem, over all its rows."""
    li = read_table(spark, sf, "lineitem")
    held = li.agg(*[F.count_if(F.expr(c)).alias(f"n{i}") for i, c in _paths().items()],
                  *[F.avg(F.when(F.expr(c), F.col("l_extendedprice"))).alias(f"v{i}") for i, c in _paths().items()]).first()
    rows = []
    for i in _paths():
        f, t, left, right = PRICE_TREE.get(i, (-1, None, -1, -1))
        rows.append((0, i, left, right, f, t, None, -1, float(held[f"n{i}"]), [float(held[f"v{i}"] or 0.0)]))
    forest = spark.createDataFrame(rows, treeshap.FOREST)
    own = li.select("l_returnflag", F.array(*PRICE_FEATURES).alias("x"))
    told = treeshap.tree_shap(own, forest, len(PRICE_FEATURES))
    per = told.select("l_returnflag", F.posexplode(F.get("shap", 0)).alias("j", "v"))
    return per.groupBy("l_returnflag", F.element_at(F.array(*[F.lit(n) for n in PRICE_FEATURES]), F.col("j") + 1).alias("feature")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean_shap"), F.avg(F.abs("v")).alias("mean_abs_shap"))


def _tree_shap_oracle() -> str:
    """All eight coalitions spelt out."""
    def expected(known: frozenset, node: int = 0) -> str:
        if node not in PRICE_TREE:
            return f"v{node}"
        f, t, left, right = PRICE_TREE[node]
        a, b = expected(known, left), expected(known, right)
        return f"(CASE WHEN {PRICE_FEATURES[f]} <= {t} THEN {a} ELSE {b} END)" if f in known else f"((n{left} * {a} + n{right} * {b}) / n{node})"
    parts = []
    for f, name in enumerate(PRICE_FEATURES):
        a, b = (j for j in range(3) if j != f)
        gains = [f"({expected(frozenset({f, *s}))} - {expected(frozenset(s))}) / {w}" for s, w in (((), 3), ((a,), 6), ((b,), 6), ((a, b), 3))]
        parts.append(f"SELECT l_returnflag, '{name}' AS feature, {' + '.join(gains)} AS v FROM lineitem, held")
    stats = ", ".join(f"CAST(count(*) FILTER ({c}) AS DOUBLE) AS n{i}, avg(l_extendedprice) FILTER ({c}) AS v{i}" for i, c in _paths().items())
    return (f"WITH held AS (SELECT {stats} FROM lineitem), per AS ({' UNION ALL '.join(parts)}) "
            "SELECT l_returnflag, feature, count(*) AS n, avg(v) AS mean_shap, avg(abs(v)) AS mean_abs_shap FROM per GROUP BY ALL")


QUERIES = {
    "tree_shap": tree_shap,
    "model_leaderboard": model_leaderboard,
    "holdout_metrics": holdout_metrics,
    "critic_status": critic_status,
    "feature_importance": feature_importance,
    "insight_pillars": insight_pillars,
    "multiclass_leaderboard": multiclass_leaderboard,
    "regression_holdout": regression_holdout,
    "linear_shap": linear_shap,
    "critic_on_scores": critic_on_scores,
    "stream_registration": stream_registration,
}


def _critic_oracle() -> str:
    from tabsight.plans.checks_metrics import SCORED_LI_SQL, _ranking_sql
    units = ("(SELECT 'units_score' AS model, l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y, "
             "floor(100 / (1 + exp(-(l_quantity * 2 - 50) / 20))) / 100 AS p FROM lineitem)")
    base = (f"(SELECT *, ('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 8))::BIGINT % 5 = 0"
            f" AS is_test FROM (SELECT * FROM {SCORED_LI_SQL} UNION ALL SELECT * FROM {units}))")
    tr = f"(SELECT model, y, p FROM {base} WHERE NOT is_test)"
    te = f"(SELECT model, y, p FROM {base} WHERE is_test)"
    return f"""WITH rtr AS ({_ranking_sql(tr)}), rte AS ({_ranking_sql(te)}),
  acc AS (SELECT model, avg(CAST((CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) = y AS DOUBLE)) AS accuracy FROM {te} GROUP BY model),
  e AS (SELECT rtr.model, rtr.roc_auc AS tr_auc, rte.roc_auc AS te_auc, rte.brier_score AS brier, rte.is_imbalanced AS imb
    FROM rtr JOIN rte ON rtr.model = rte.model),
  f AS (
    SELECT model AS experiment_id, 'severe_overfitting' AS issue_type, 'critical' AS severity, model AS affected,
      'REGULARIZE_MODEL' AS action FROM e WHERE tr_auc >= 0.98 AND te_auc < 0.82 AND te_auc > 0
    UNION ALL SELECT model, 'moderate_overfitting', 'warning', model, NULL FROM e
      WHERE NOT (tr_auc >= 0.98 AND te_auc < 0.82 AND te_auc > 0) AND tr_auc - te_auc > 0.15 AND te_auc > 0
    UNION ALL SELECT model, 'domain_target_leakage', 'critical', 'post_sale_units', 'REMOVE_LEAKY_FEATURES' FROM e
      WHERE model = 'units_score'
    UNION ALL SELECT model, 'suspicious_performance', 'warning', model, NULL FROM e WHERE te_auc >= 0.995
    UNION ALL SELECT model, 'poor_calibration', 'warning', model, NULL FROM e WHERE brier > 0.20
    UNION ALL SELECT model, 'class_imbalance_accuracy_hazard', 'warning', 'evaluation_metrics,' || model, NULL FROM e WHERE imb),
  st AS (SELECT experiment_id, CASE WHEN bool_or(severity = 'critical') THEN 'CRITICAL_ISSUES_FOUND'
      WHEN bool_or(severity = 'warning') THEN 'WARNINGS_IDENTIFIED' ELSE 'PASSED' END AS audit_status FROM f GROUP BY 1)
SELECT f.experiment_id, issue_type, severity, affected, action, audit_status FROM f JOIN st ON f.experiment_id = st.experiment_id"""


def oracle() -> dict[str, str]:
    inv = " UNION ALL ".join(
        f"SELECT '{t}' AS name, 'parquet' AS file_type, CAST(count(*) AS BIGINT) AS row_count, "
        f"(SELECT CAST(count(*) AS BIGINT) FROM information_schema.columns WHERE table_name = '{t}') AS col_count FROM {t}"
        for t in TABLES)
    return {"stream_registration": inv, "tree_shap": _tree_shap_oracle(), "critic_on_scores": _critic_oracle()}
