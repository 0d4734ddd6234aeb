"""Registered evaluation queries on deterministic
score columns computed from the driver tables (logistic formulas of table columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.functions import exprs as X
from tabsight.operators import metrics as M
from tabsight.session import read_table

# ---------------------------------------------------------------------------
# Scored frames
# ---------------------------------------------------------------------------


def scored_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Two deterministic scorers of 'returned' (l_returnflag = 'R') per line item, 2-dp floored scores."""
    li = read_table(spark, sf, "lineitem")
    y = (F.col("l_returnflag") == "R").cast("int").alias("y")
    qty = (F.floor(100 / (1 + F.exp(-(F.col("l_quantity") - 25) / 10))) / 100).alias("p")
    disc = (F.floor(100 * (F.col("l_discount") * 5 + F.col("l_tax") * 2)) / 100).alias("p")
    keys = ["l_orderkey", "l_linenumber"]
    return (li.select(F.lit("qty_score").alias("model"), *keys, y, qty)
              .unionByName(li.select(F.lit("disc_score").alias("model"), *keys, y, disc)))


SCORED_LI_SQL = """(SELECT 'qty_score' AS model, l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y,
    floor(100 / (1 + exp(-(l_quantity - 25) / 10))) / 100 AS p FROM lineitem
  UNION ALL SELECT 'disc_score', l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER),
    floor(100 * (l_discount * 5 + l_tax * 2)) / 100 FROM lineitem)"""


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    lab = read_table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        F.lit("len_score").alias("model"), "doc_id", F.col("toxic").alias("y"),
        (F.floor(100 / (1 + F.exp(-(F.ln(F.col("n_chars")) - 7)))) / 100).alias("p"))


SCORED_DOC_SQL = """(SELECT 'len_score' AS model, d.doc_id, l.toxic AS y,
    floor(100 / (1 + exp(-(ln(d.n_chars) - 7)))) / 100 AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


CLASSES, COMPONENTS = 10, 64


def scored_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax over all embedding components, those of one remainder modulo ten making one class; a row per (vector, class)."""
    e = read_table(spark, sf, "embeddings")
    comps = [F.exp(F.element_at("embedding", c + 1).cast("double")) for c in range(COMPONENTS)]

    def added(xs):
        out = xs[0]
        for x in xs[1:]:
            out = out + x
        return out
    per = [added(comps[c::CLASSES]) for c in range(CLASSES)]
    d = e.select("vec_id", F.col("label").alias("y"), F.array(*per).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    return d.withColumn("total", total).select("vec_id", "y", F.posexplode(F.transform("s", lambda x: x / F.col("total"))).alias("cls", "p"))


def _emb_sql() -> str:
    per = [" + ".join(f"exp(CAST(embedding[{i + 1}] AS DOUBLE))" for i in range(c, COMPONENTS, CLASSES)) for c in range(CLASSES)]
    scored = f"(SELECT vec_id, label AS y, [{', '.join(per)}] AS s FROM embeddings)"
    return f"(SELECT vec_id, y, c AS cls, s[c + 1] / list_sum(s) AS p FROM {scored}, range(0, {CLASSES}) t(c))"


# ---------------------------------------------------------------------------
# Spark queries
# ---------------------------------------------------------------------------

def threshold_table(spark, sf):
    return M.threshold_table(scored_lineitem(spark, sf), "y", "p", ["model"])


def operating_threshold(spark, sf):
    a = M.operating_threshold(M.threshold_table(scored_lineitem(spark, sf), "y", "p", ["model"]), ["model"])
    b = M.operating_threshold(M.threshold_table(scored_documents(spark, sf), "y", "p", ["model"]), ["model"],
                              marketing=True)
    cols = ["model", "objective", "threshold", "precision", "recall", "f1", "f2", "tp", "fp", "fn", "tn",
            "default_recall", "default_tp", "recall_gain", "tp_gain"]
    return a.select(*cols).unionByName(b.select(*cols))


def ranking_metrics(spark, sf):
    return M.ranking_metrics(scored_lineitem(spark, sf), "y", "p", ["model"]).unionByName(
        M.ranking_metrics(scored_documents(spark, sf), "y", "p", ["model"]))


def roc_points(spark, sf):
    return M.roc_points(scored_lineitem(spark, sf), "y", "p", ["model"]).unionByName(
        M.roc_points(scored_documents(spark, sf), "y", "p", ["model"]))


def pr_points(spark, sf):
    return M.pr_points(scored_lineitem(spark, sf), "y", "p", ["model"]).unionByName(
        M.pr_points(scored_documents(spark, sf), "y", "p", ["model"]))


def calibration_bins(spark, sf):
    return M.calibration_bins(scored_lineitem(spark, sf), "y", "p", ["model"])


def _predicted(spark, sf):
    return scored_lineitem(spark, sf).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


def classification_report(spark, sf):
    return M.classification_metrics(_predicted(spark, sf), "y", "pred", ["model"], positive="1")


def confusion_matrix(spark, sf):
    return M.confusion_counts(_predicted(spark, sf), "y", "pred", ["model"])


def multiclass_ovr(spark, sf):
    s = scored_embeddings(spark, sf)
    ovr = M.ovr_metrics(s, "y", "cls", "p", None)
    pred = s.groupBy("vec_id", "y").agg(F.max_by("cls", F.struct("p", -F.col("cls"))).alias("pred"),
                                        F.max(F.when(F.col("cls") == F.col("y"), F.col("p"))).alias("p_true"))
    cm = M.classification_metrics(pred, "y", "pred", None, positive=None)
    ll = pred.agg(F.avg(-F.ln(F.least(F.greatest("p_true", F.lit(M.LOG_EPS)), F.lit(1 - M.LOG_EPS)))).alias("log_loss"))
    return ovr.withColumn("_k", F.lit(1)).join(cm.withColumn("_k", F.lit(1)), "_k") \
              .join(ll.withColumn("_k", F.lit(1)), "_k").drop("_k")


def multiclass_curves(spark, sf):
    return M.ovr_curves(scored_embeddings(spark, sf), "y", "cls", "p")


def _order_predictions(spark, sf):
    o = read_table(spark, sf, "orders")
    li = read_table(spark, sf, "lineitem")
    pred = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("pred"))
    return o.join(pred, o.o_orderkey == pred.l_orderkey).select("o_orderkey", "o_orderstatus",
                                                                 F.col("o_totalprice").alias("y"), "pred")


def regression_metrics(spark, sf):
    return M.regression_metrics(_order_predictions(spark, sf), "y", "pred", ["o_orderstatus"])


def cv_fold_summary(spark, sf):
    s = scored_lineitem(spark, sf)
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    s = s.withColumn("fold", (X.hash_rank_key(key) % 3).cast("int"))
    folds = M.ranking_metrics(s, "y", "p", ["model", "fold"]).select("model", "fold", "roc_auc")
    return M.cv_summary(folds, ["model"], "roc_auc")


def actual_vs_predicted_sample(spark, sf):
    from tabsight.operators import evidence as EV
    return EV.hash_sample(_order_predictions(spark, sf).select("o_orderkey", "y", "pred"), "o_orderkey", 500)


def residual_histogram(spark, sf):
    from tabsight.operators import evidence as EV
    return EV.residual_histogram(_order_predictions(spark, sf), "y", "pred", 25)


def _qty_table(spark, sf):
    return M.threshold_table(scored_lineitem(spark, sf).where(F.col("model") == "qty_score"), "y", "p")


def threshold_excerpt(spark, sf):
    from tabsight.operators import evidence as EV
    tt = _qty_table(spark, sf)
    sel = M.operating_threshold(tt).first()["threshold"]
    return EV.threshold_excerpt(tt, sel, 9).select("threshold", "precision", "recall", "f1", "tp", "fp", "fn", "tn")


def default_vs_locked(spark, sf):
    from tabsight.operators import evidence as EV
    tt = _qty_table(spark, sf)
    sel = M.operating_threshold(tt).first()["threshold"]
    prev = scored_lineitem(spark, sf).where(F.col("model") == "qty_score").agg(F.avg("y")).first()[0]
    return EV.default_vs_locked(tt, sel, prev).withColumn("locked_threshold", F.lit(sel))


QUERIES = {
    "actual_vs_predicted_sample": actual_vs_predicted_sample,
    "residual_histogram": residual_histogram,
    "threshold_excerpt": threshold_excerpt,
    "default_vs_locked": default_vs_locked,
    "threshold_table": threshold_table,
    "operating_threshold": operating_threshold,
    "ranking_metrics": ranking_metrics,
    "roc_points": roc_points,
    "pr_points": pr_points,
    "calibration_bins": calibration_bins,
    "classification_report": classification_report,
    "confusion_matrix": confusion_matrix,
    "multiclass_ovr": multiclass_ovr,
    "multiclass_curves": multiclass_curves,
    "regression_metrics": regression_metrics,
    "cv_fold_summary": cv_fold_summary,
}

# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------

_GRID_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, {t!r}::DOUBLE)" for i, t in enumerate(M.THRESHOLD_GRID)) + ") g(i, threshold))"


def _rates(tp="tp", fp="fp", fn="fn", tn="tn") -> str:
    def r(n, d):
        return f"CASE WHEN ({d}) > 0 THEN ({n})::DOUBLE / ({d}) ELSE 0.0 END"
    rec, spec = r(tp, f"{tp} + {fn}"), r(tn, f"{tn} + {fp}")
    return (f"{r(tp, f'{tp} + {fp}')} AS precision, {rec} AS recall, {r(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1, "
            f"{r(f'5 * {tp}', f'5 * {tp} + 4 * {fn} + {fp}')} AS f2, ({rec} + {spec}) / 2 AS balanced_accuracy, "
            f"{spec} AS specificity, {r(f'{tp} + {tn}', f'{tp} + {fp} + {fn} + {tn}')} AS accuracy")


def _threshold_sql(src: str) -> str:
    return f"""SELECT model, threshold, tp, fp, fn, tn, {_rates()} FROM (
  SELECT s.model, g.threshold, CAST(count_if(s.y = 1 AND s.p >= g.threshold) AS BIGINT) AS tp,
    CAST(count_if(s.y <> 1 AND s.p >= g.threshold) AS BIGINT) AS fp,
    CAST(count_if(s.y = 1 AND s.p < g.threshold) AS BIGINT) AS fn,
    CAST(count_if(s.y <> 1 AND s.p < g.threshold) AS BIGINT) AS tn
  FROM {src} s, {_GRID_SQL} g GROUP BY s.model, g.threshold)"""


def _operating_sql(src: str, marketing: bool) -> str:
    k1, k2 = ("f2", "f1") if marketing else ("f1", "balanced_accuracy")
    return f"""WITH t AS ({_threshold_sql(src)}),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round({k1}, 4) DESC, round({k2}, 4) DESC,
        threshold) AS rn FROM t) WHERE rn = 1),
  d AS (SELECT model, recall AS default_recall, tp AS default_tp FROM t WHERE abs(threshold - 0.5) < 1e-3)
SELECT b.model, '{'f2' if marketing else 'f1'}' AS objective, threshold, precision, recall, f1, f2, tp, fp, fn, tn,
  default_recall, default_tp, recall - default_recall AS recall_gain, tp - default_tp AS tp_gain
FROM b LEFT JOIN d ON b.model = d.model"""


def _cum_sql(src: str) -> str:
    return f"""s AS (SELECT model, CAST(p AS DOUBLE) AS sc, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
      sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY model, p),
  c AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, row_number() OVER w AS idx,
      count(*) OVER (PARTITION BY model) AS D, sum(pos) OVER (PARTITION BY model) AS P,
      sum(neg) OVER (PARTITION BY model) AS N, sum(neg) OVER (PARTITION BY model) - sum(neg) OVER w AS neg_below
    FROM s WINDOW w AS (PARTITION BY model ORDER BY sc DESC ROWS UNBOUNDED PRECEDING))"""


def _ranking_sql(src: str) -> str:
    eps = repr(M.LOG_EPS)
    return f"""WITH {_cum_sql(src)},
  r AS (SELECT model, sum(pos * (neg_below + 0.5 * neg)) AS auc_num, sum(pos * tps / (tps + fps)) AS ap_num,
      any_value(P) AS P, any_value(N) AS N FROM c GROUP BY model),
  q AS (SELECT model, avg((p - y) * (p - y)) AS brier_score,
      avg(-(y * ln(least(greatest(p, {eps}), 1 - {eps})) + (1 - y) * ln(1 - least(greatest(p, {eps}), 1 - {eps})))) AS log_loss,
      avg(CAST(y AS DOUBLE)) AS prevalence FROM {src} GROUP BY model)
SELECT r.model, CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg,
  CASE WHEN P > 0 AND N > 0 THEN auc_num / (P::DOUBLE * N) END AS roc_auc, CASE WHEN P > 0 THEN ap_num / P END AS pr_auc,
  brier_score, log_loss, prevalence, prevalence < 0.25 OR prevalence > 0.75 AS is_imbalanced,
  greatest(prevalence, 1 - prevalence) AS majority_baseline FROM r JOIN q ON r.model = q.model"""


def _picks_sql(mtable: str) -> str:
    return f"""(SELECT model, CASE WHEN j = least(m, 50) - 1 THEN m - 1
      ELSE CAST(floor(j * ((m - 1)::DOUBLE / (least(m, 50) - 1))) AS BIGINT) END AS pos
    FROM {mtable}, range(0, 50) r(j) WHERE j < least(m, 50))"""


def _roc_sql(src: str) -> str:
    return f"""WITH {_cum_sql(src)},
  n AS (SELECT *, lag(tps) OVER w AS tp_prev, lag(fps) OVER w AS fp_prev, lead(tps) OVER w AS tp_next,
      lead(fps) OVER w AS fp_next FROM c WINDOW w AS (PARTITION BY model ORDER BY idx)),
  k AS (SELECT * FROM n WHERE D <= 2 OR idx = 1 OR idx = D OR (fp_next - 2 * fps + fp_prev) <> 0
      OR (tp_next - 2 * tps + tp_prev) <> 0),
  pts AS (SELECT model, row_number() OVER (PARTITION BY model ORDER BY idx) AS pos, sc AS threshold, fps, tps, P, N FROM k
      UNION ALL SELECT DISTINCT model, 0, 'inf'::DOUBLE, 0, 0, P, N FROM c),
  m AS (SELECT model, count(*) AS m FROM pts GROUP BY model)
SELECT DISTINCT pts.model, CAST(pts.pos AS BIGINT) AS point, threshold,
  CASE WHEN N > 0 THEN fps / N::DOUBLE ELSE 0.0 END AS fpr, CASE WHEN P > 0 THEN tps / P::DOUBLE ELSE 0.0 END AS tpr
FROM pts JOIN {_picks_sql('m')} k USING (model, pos)"""


def _pr_sql(src: str) -> str:
    return f"""WITH {_cum_sql(src)},
  f AS (SELECT model, min(idx) AS last FROM c WHERE tps = P GROUP BY model),
  pts AS (SELECT c.model, last - idx AS pos, sc AS threshold,
      CASE WHEN tps + fps > 0 THEN tps / (tps + fps)::DOUBLE ELSE 0.0 END AS precision,
      CASE WHEN P > 0 THEN tps / P::DOUBLE ELSE 0.0 END AS recall FROM c JOIN f ON c.model = f.model WHERE idx <= last
    UNION ALL SELECT model, last, NULL::DOUBLE, 1.0, 0.0 FROM f),
  m AS (SELECT model, last + 1 AS m FROM f)
SELECT DISTINCT pts.model, CAST(pts.pos AS BIGINT) AS point, threshold, precision, recall
FROM pts JOIN {_picks_sql('m')} k USING (model, pos)"""


def _calib_sql(src: str) -> str:
    edges = [i * (1.0 / M.CALIBRATION_BINS) for i in range(1, M.CALIBRATION_BINS)]
    b = " + ".join(f"CAST({e!r}::DOUBLE < p AS INTEGER)" for e in edges)
    return f"""SELECT model, CAST({b} AS INTEGER) AS bin, avg(CAST(y AS DOUBLE)) AS prob_true, avg(CAST(p AS DOUBLE)) AS prob_pred,
  CAST(count(*) AS BIGINT) AS n FROM {src} GROUP BY model, bin"""


def _class_sql(src: str, with_positive: bool) -> str:
    ctes = f"""WITH cc AS (SELECT model, CAST(y AS VARCHAR) AS actual, CAST(pred AS VARCHAR) AS predicted, count(*) AS n
    FROM {src} GROUP BY ALL),
  la AS (SELECT model, actual AS label, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp
    FROM cc GROUP BY ALL),
  lp AS (SELECT model, predicted AS label, sum(n) AS predicted_n FROM cc GROUP BY ALL),
  lab AS (SELECT coalesce(la.model, lp.model) AS model, coalesce(la.label, lp.label) AS label,
      coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(predicted_n, 0) AS predicted_n
    FROM la FULL JOIN lp ON la.model = lp.model AND la.label = lp.label),
  agg AS (SELECT model, sum(tp) / sum(support)::DOUBLE AS accuracy,
      avg(CASE WHEN support > 0 THEN tp / support::DOUBLE END) AS balanced_accuracy,
      avg(CASE WHEN predicted_n > 0 THEN tp / predicted_n::DOUBLE ELSE 0.0 END) AS precision_macro,
      avg(CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0.0 END) AS recall_macro,
      avg(CASE WHEN support + predicted_n > 0 THEN 2 * tp / (support + predicted_n)::DOUBLE ELSE 0.0 END) AS f1_macro,
      sum(CASE WHEN support + predicted_n > 0 THEN 2 * tp / (support + predicted_n)::DOUBLE ELSE 0.0 END * support)
        / sum(support) AS f1_weighted,
      CAST(sum(support) AS BIGINT) AS n FROM lab GROUP BY model)"""
    head = "model, accuracy, balanced_accuracy, precision_macro, recall_macro, f1_macro, f1_weighted"
    if not with_positive:
        return f"{ctes} SELECT {head}, n FROM agg"
    rates = (_rates().replace(" AS precision,", " AS precision_positive,").replace(" AS recall,", " AS recall_positive,")
             .replace(" AS f1,", " AS f1_positive,").replace(" AS f2,", " AS f2_positive,")
             .replace(" AS balanced_accuracy,", " AS _ba,").replace(" AS accuracy", " AS _acc"))
    return f"""{ctes},
  p1 AS (SELECT model, tp AS tp1, predicted_n - tp AS fp1, support - tp AS fn1 FROM lab WHERE label = '1'),
  x AS (SELECT agg.*, CAST(coalesce(tp1, 0) AS BIGINT) AS tp, CAST(coalesce(fp1, 0) AS BIGINT) AS fp,
      CAST(coalesce(fn1, 0) AS BIGINT) AS fn,
      CAST(n - coalesce(tp1, 0) - coalesce(fp1, 0) - coalesce(fn1, 0) AS BIGINT) AS tn
    FROM agg LEFT JOIN p1 ON agg.model = p1.model)
SELECT {head}, precision_positive, recall_positive, f1_positive, f2_positive, specificity, tp, fp, fn, tn
FROM (SELECT *, {rates} FROM x)"""


def _regression_sql() -> str:
    src = """(SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice AS y, p.pred FROM orders o JOIN
      (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS pred FROM lineitem GROUP BY l_orderkey) p
      ON o.o_orderkey = p.l_orderkey)"""
    return f"""SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, avg(abs(y - pred)) AS mae, avg((y - pred) * (y - pred)) AS mse,
  sqrt(avg((y - pred) * (y - pred))) AS rmse,
  CASE WHEN var_pop(y) * count(*) = 0 THEN CASE WHEN sum((y - pred) * (y - pred)) = 0 THEN 1.0 ELSE 0.0 END
       ELSE 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) END AS r2,
  quantile_cont(abs(y - pred), 0.5) AS median_ae,
  avg(abs((y - pred) / CASE WHEN y = 0 THEN 1e-6 ELSE y END)) * 100.0 AS mape, max(abs(y - pred)) AS max_residual,
  quantile_cont(y - pred, 0.1) AS residual_p10, quantile_cont(y - pred, 0.25) AS residual_p25,
  quantile_cont(y - pred, 0.5) AS residual_p50, quantile_cont(y - pred, 0.75) AS residual_p75,
  quantile_cont(y - pred, 0.9) AS residual_p90 FROM {src} GROUP BY o_orderstatus"""


def _cv_sql() -> str:
    src = f"""(SELECT *, CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 8))::BIGINT % 3
      AS INTEGER) AS fold FROM {SCORED_LI_SQL})"""
    per = f"""WITH s AS (SELECT model, fold, p AS sc, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
      sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY model, fold, p),
  c AS (SELECT *, sum(neg) OVER (PARTITION BY model, fold) - sum(neg) OVER w AS neg_below,
      sum(pos) OVER (PARTITION BY model, fold) AS P, sum(neg) OVER (PARTITION BY model, fold) AS N
    FROM s WINDOW w AS (PARTITION BY model, fold ORDER BY sc DESC ROWS UNBOUNDED PRECEDING)),
  f AS (SELECT model, fold, sum(pos * (neg_below + 0.5 * neg)) / (any_value(P)::DOUBLE * any_value(N)) AS roc_auc
    FROM c GROUP BY model, fold)"""
    return per + """ SELECT model, avg(roc_auc) AS cv_mean, stddev_pop(roc_auc) AS cv_std, CAST(count(*) AS BIGINT) AS n_folds
FROM f GROUP BY model"""


def _ovr_sql() -> str:
    emb = _emb_sql()
    eps = repr(M.LOG_EPS)
    return f"""WITH b AS (SELECT cls AS model, CASE WHEN y = cls THEN 1 ELSE 0 END AS y, p FROM {emb}),
  rk AS ({_ranking_sql('b')}),
  ovr AS (SELECT avg(roc_auc) AS macro_roc_auc, avg(pr_auc) AS macro_pr_auc, CAST(count(*) AS BIGINT) AS n_classes FROM rk),
  pr AS (SELECT vec_id, y, arg_max(cls, p) AS pred, max(CASE WHEN cls = y THEN p END) AS p_true FROM {emb} GROUP BY vec_id, y),
  cm AS ({_class_sql("(SELECT 'm' AS model, y, pred FROM pr)", False)}),
  ll AS (SELECT avg(-ln(least(greatest(p_true, {eps}), 1 - {eps}))) AS log_loss FROM pr)
SELECT macro_roc_auc, macro_pr_auc, n_classes, accuracy, balanced_accuracy, precision_macro, recall_macro, f1_macro,
  f1_weighted, n, log_loss FROM ovr, cm, ll"""


def oracle() -> dict[str, str]:
    pred_src = f"(SELECT model, y, CAST(p >= 0.5 AS INTEGER) AS pred FROM {SCORED_LI_SQL})"
    cols = ("model, objective, threshold, precision, recall, f1, f2, tp, fp, fn, tn, default_recall, default_tp, "
            "recall_gain, tp_gain")
    preds = """(SELECT o.o_orderkey, o.o_totalprice AS y, p.pred FROM orders o JOIN
      (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS pred FROM lineitem GROUP BY l_orderkey) p
      ON o.o_orderkey = p.l_orderkey)"""
    qty = "(SELECT * FROM " + SCORED_LI_SQL + " WHERE model = 'qty_score')"
    op = f"(SELECT threshold FROM ({_operating_sql(qty, False)}))"
    tt = f"({_threshold_sql(qty)})"
    return {
        "actual_vs_predicted_sample": f"""SELECT o_orderkey, y, pred FROM {preds}
  ORDER BY ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT, o_orderkey LIMIT 500""",
        "residual_histogram": f"""WITH r AS (SELECT y - pred AS r FROM {preds}), b AS (SELECT min(r) AS lo, max(r) AS hi FROM r),
  w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / 25 ELSE 1.0 END AS width FROM b)
SELECT CAST(least(floor((r - lo) / width), 24) AS INTEGER) AS bin, any_value(lo) + CAST(least(floor((r - lo) / width), 24) AS INTEGER) * any_value(width) AS lower,
  any_value(lo) + (CAST(least(floor((r - lo) / width), 24) AS INTEGER) + 1) * any_value(width) AS upper, CAST(count(*) AS BIGINT) AS count
FROM r, w GROUP BY 1""",
        "threshold_excerpt": f"""SELECT threshold, precision, recall, f1, tp, fp, fn, tn FROM (
  SELECT *, row_number() OVER (ORDER BY threshold) AS rn FROM {tt} t
  WHERE round(threshold * 100) % 10 = 0 OR abs(threshold - {op}) < 1e-9) WHERE rn <= 9""",
        "default_vs_locked": f"""SELECT (l.recall - d.recall) * 100 AS recall_shift_points, l.tp - d.tp AS tp_gain, d.fn - l.fn AS fn_reduction,
  l.precision AS l_precision, d.precision AS d_precision,
  CASE WHEN pv > 0 THEN l.precision / pv END AS precision_lift, {op} AS locked_threshold
FROM (SELECT * FROM {tt} WHERE abs(threshold - 0.5) < 1e-3) d, (SELECT * FROM {tt} WHERE abs(threshold - {op}) < 1e-9) l,
  (SELECT avg(CAST(y AS DOUBLE)) AS pv FROM {qty})""",
        "threshold_table": _threshold_sql(SCORED_LI_SQL),
        "operating_threshold": f"SELECT {cols} FROM ({_operating_sql(SCORED_LI_SQL, False)}) UNION ALL "
                               f"SELECT {cols} FROM ({_operating_sql(SCORED_DOC_SQL, True)})",
        "ranking_metrics": f"{_ranking_sql(SCORED_LI_SQL)} UNION ALL SELECT * FROM ({_ranking_sql(SCORED_DOC_SQL)})",
        "roc_points": f"SELECT * FROM ({_roc_sql(SCORED_LI_SQL)}) UNION ALL SELECT * FROM ({_roc_sql(SCORED_DOC_SQL)})",
        "pr_points": f"SELECT * FROM ({_pr_sql(SCORED_LI_SQL)}) UNION ALL SELECT * FROM ({_pr_sql(SCORED_DOC_SQL)})",
        "calibration_bins": _calib_sql(SCORED_LI_SQL),
        "classification_report": _class_sql(pred_src, True),
        "confusion_matrix": f"""SELECT model, CAST(y AS VARCHAR) AS actual, CAST(pred AS VARCHAR) AS predicted,
  CAST(count(*) AS BIGINT) AS count FROM {pred_src} GROUP BY ALL""",
        "multiclass_ovr": _ovr_sql(),
        "regression_metrics": _regression_sql(),
        "cv_fold_summary": _cv_sql(),
    }
