"""Evaluation metrics as aggregations over scored rows.

Scored input: one row per prediction with a label column, a positive-class score
and optional group columns (model, fold, class).  Ranking metrics first collapse
to one row per distinct score per group (a heavy score is one row), then use the
bucketed prefix sums of ``ordered`` -- never a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.functions import exprs as X
from tabsight.operators.ordered import exact_quantiles, null_safe_join, prefix_sum
from tabsight.session import cut_lineage

# The cutoff grid 0.05, 0.10, ..., 0.95 (two decimals) and the calibration bins.
THRESHOLD_GRID = [round(0.05 * i, 2) for i in range(1, 20)]
CALIBRATION_BINS = 10
CURVE_POINTS = 50
LOG_EPS = 2.220446049250313e-16  # machine epsilon of float64, used to clip probabilities


def _ensure_group(df: DataFrame, group_cols: list[str] | None) -> tuple[DataFrame, list[str], bool]:
    """Metrics always aggregate per group; without groups a constant key stands in."""
    g = list(group_cols or [])
    if g:
        return df, g, False
    return df.withColumn("_g", F.lit(0)), ["_g"], True


def _finish(df: DataFrame, added: bool) -> DataFrame:
    return df.drop("_g") if added else df


def _cnt(c: Column) -> Column:
    return F.sum(c.cast("long"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def confusion_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, F2, specificity, balanced accuracy, accuracy from counts (zero division -> 0)."""
    prec = _ratio(tp, tp + fp)
    rec = _ratio(tp, tp + fn)
    spec = _ratio(tn, tn + fp)
    return {
        "precision": prec, "recall": rec,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "f2": _ratio(5 * tp, 5 * tp + 4 * fn + fp),
        "balanced_accuracy": (rec + spec) / 2,
        "specificity": spec,
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
    }


# ---------------------------------------------------------------------------
# Thresholds
# ---------------------------------------------------------------------------

def threshold_table(scored: DataFrame, y: str, p: str, group_cols: list[str] | None = None,
                    grid: list[float] | None = None) -> DataFrame:
    """Counts and rates at each cutoff (predict positive when p >= cutoff).

    Each row falls in bucket b = number of cutoffs at or below its score; rows are counted per
    (group, bucket, label) in one aggregation, and a bucket's counts then add to every cutoff
    index <= b (at most len(grid) entries per bucket) -- no rows x cutoffs product.
    """
    scored, g, added = _ensure_group(scored, group_cols)
    grid = sorted(grid or THRESHOLD_GRID)
    cut = F.array(*[F.lit(float(t)) for t in grid])
    b = scored.select(*g, F.col(y).cast("int").alias("_y"), X.count_below(grid, F.col(p), inclusive=True).alias("_b"))
    # (groups x buckets) rows, read by two branches below: written once so the raw rows are read once
    counts = cut_lineage(b.groupBy(*g, "_b").agg(_cnt(F.col("_y") == 1).alias("_pos"), _cnt(F.col("_y") != 1).alias("_neg")))
    tot = counts.groupBy(*g).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    spread = counts.where(F.col("_b") > 0).select(*g, "_pos", "_neg", F.explode(F.sequence(F.lit(1), F.col("_b"))).alias("_i"))
    hits = spread.groupBy(*g, "_i").agg(F.sum("_pos").alias("tp"), F.sum("_neg").alias("fp"))
    keys = tot.select(*g, "_P", "_N", F.posexplode(cut).alias("_i0", "threshold")).withColumn("_i", F.col("_i0") + 1)
    full = keys.join(hits, [*g, "_i"], "left").fillna(0, ["tp", "fp"])
    tp, fp = F.col("tp").cast("long"), F.col("fp").cast("long")
    fn, tn = (F.col("_P") - tp).cast("long"), (F.col("_N") - fp).cast("long")
    r = confusion_rates(tp, fp, fn, tn)
    out = full.select(*g, "threshold", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
                      *[v.alias(k) for k, v in r.items()])
    return _finish(out, added)


def operating_threshold(table: DataFrame, group_cols: list[str] | None = None, marketing: bool = False,
                        default: float = 0.5) -> DataFrame:
    """Per group the arg-max cutoff on 4-dp rounded (F2, F1) for marketing goals,
    else (F1, balanced accuracy); the lowest cutoff wins ties.  Adds the 0.50 row's recall/tp
    and the gains over it."""
    table, g, added = _ensure_group(table, group_cols)
    k1, k2 = ("f2", "f1") if marketing else ("f1", "balanced_accuracy")
    key = F.struct(F.round(k1, 4), F.round(k2, 4), -F.col("threshold"))
    best = table.groupBy(*g).agg(F.max_by(F.struct(*[c for c in table.columns if c not in g]), key).alias("b"))
    dflt = table.where(F.abs(F.col("threshold") - default) < 1e-3).select(
        *g, F.col("recall").alias("default_recall"), F.col("tp").alias("default_tp"), F.col("fn").alias("default_fn"),
        F.col("precision").alias("default_precision"))
    out = best.select(*g, "b.*").join(dflt, g, "left")
    out = out.withColumn("objective", F.lit("f2" if marketing else "f1")) \
             .withColumn("recall_gain", F.col("recall") - F.col("default_recall")) \
             .withColumn("tp_gain", F.col("tp") - F.col("default_tp"))
    return _finish(out, added)


# ---------------------------------------------------------------------------
# Ranking metrics
# ---------------------------------------------------------------------------

def score_counts(scored: DataFrame, y: str, p: str, group_cols: list[str]) -> DataFrame:
    """(group, score, pos, neg) per distinct score."""
    return scored.groupBy(*group_cols, F.col(p).cast("double").alias("_s")).agg(
        _cnt(F.col(y).cast("int") == 1).alias("_pos"), _cnt(F.col(y).cast("int") != 1).alias("_neg"))


def cumulative_scores(scored: DataFrame, y: str, p: str, group_cols: list[str], materialize: bool = True) -> DataFrame:
    """Per distinct score: tp/fp counted at scores >= s (descending cumulation) and totals.

    With ``materialize`` the per-score counts are written once (they feed the bucket bounds, the
    window and the totals) and so is the result, for callers that read it several times."""
    sc = score_counts(scored, y, p, group_cols)
    n_rows = None
    if materialize:
        sc = cut_lineage(sc)
        n_rows = sc.count()
    cum = prefix_sum(sc, group_cols, "_s", {"_cpos": "_pos", "_cneg": "_neg", "_crank": F.lit(1)}, n_rows=n_rows)
    tot = sc.groupBy(*group_cols).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"),
                                      F.count(F.lit(1)).alias("_D"))
    j = null_safe_join(cum, tot, group_cols)  # one row per group
    out = j.select(*group_cols, "_s", "_pos", "_neg", "_P", "_N", "_D",
                   (F.col("_P") - F.col("_cpos") + F.col("_pos")).alias("tps"),
                   (F.col("_N") - F.col("_cneg") + F.col("_neg")).alias("fps"),
                   (F.col("_cneg") - F.col("_neg")).alias("_neg_below"),
                   (F.col("_D") - F.col("_crank") + 1).alias("idx"))  # 1 = highest score
    return cut_lineage(out) if materialize else out


def ranking_metrics(scored: DataFrame, y: str, p: str, group_cols: list[str] | None = None) -> DataFrame:
    """roc_auc (ties count one half), average precision (step-wise), brier, log_loss, prevalence."""
    scored, g, added = _ensure_group(scored, group_cols)
    cs = cumulative_scores(scored, y, p, g)
    # every metric comes from the per-distinct-score counts (written once): raw rows are read once
    sc, pos, neg = F.col("_s"), F.col("_pos"), F.col("_neg")
    pc = F.least(F.greatest(sc, F.lit(LOG_EPS)), F.lit(1 - LOG_EPS))
    j = cs.groupBy(*g).agg(
        F.sum(pos * (F.col("_neg_below") + 0.5 * neg)).alias("_auc_num"),
        F.sum(pos * F.col("tps") / (F.col("tps") + F.col("fps"))).alias("_ap_num"),
        F.first("_P").alias("n_pos"), F.first("_N").alias("n_neg"),
        (F.sum(pos * (sc - 1) * (sc - 1) + neg * sc * sc) / F.sum(pos + neg)).alias("brier_score"),
        (F.sum(pos * -F.ln(pc) + neg * -F.ln(1 - pc)) / F.sum(pos + neg)).alias("log_loss"),
        (F.sum(pos) / F.sum(pos + neg)).alias("prevalence"))
    P, N = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return _finish(j.select(*g, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
                    F.when((P > 0) & (N > 0), F.col("_auc_num") / (P * N)).alias("roc_auc"),
                    F.when(P > 0, F.col("_ap_num") / P).alias("pr_auc"),
                    "brier_score", "log_loss", "prevalence",
                    ((F.col("prevalence") < 0.25) | (F.col("prevalence") > 0.75)).alias("is_imbalanced"),
                    F.greatest(F.col("prevalence"), 1 - F.col("prevalence")).alias("majority_baseline")), added)


def _linspace_pick(idx: Column, m: Column, k: int) -> Column:
    """True when position ``idx`` (0-based, of m points) is in int(linspace(0, m-1, min(m, k))).

    linspace evaluates j*step (step = (m-1)/(num-1)) for j < num-1 and pins the last point to
    m-1; the candidates for a position are j = floor(idx/step) and the next one.
    """
    num = F.least(m, F.lit(k))
    step = (m - 1).cast("double") / (num - 1).cast("double")
    j0 = F.floor(idx.cast("double") / step)
    j1 = j0 + 1

    def lands(j: Column) -> Column:
        return (j >= 0) & (j <= num - 2) & (F.floor(j * step) == idx)
    return F.when(num <= 1, idx == 0).otherwise(lands(j0) | lands(j1) | (idx == m - 1))


def roc_points(scored: DataFrame | None, y: str, p: str, group_cols: list[str] | None = None,
               max_points: int | None = CURVE_POINTS, cum: DataFrame | None = None) -> DataFrame:
    """ROC vertices (collinear points dropped, origin prepended), evenly sub-sampled to <= 50.
    ``cum`` may carry precomputed ``cumulative_scores`` (grouped by ``group_cols``)."""
    if cum is None:
        scored, g, added = _ensure_group(scored, group_cols)
        cum = cumulative_scores(scored, y, p, g)
    else:
        g, added = list(group_cols), False
    cs = cum.select(*g, "idx", "tps", "fps", "_s", "_D", "_P", "_N")
    prev = cs.select(*g, (F.col("idx") + 1).alias("idx"), F.col("tps").alias("_tp_prev"), F.col("fps").alias("_fp_prev"))
    nxt = cs.select(*g, (F.col("idx") - 1).alias("idx"), F.col("tps").alias("_tp_next"), F.col("fps").alias("_fp_next"))
    nb = cs.join(prev, [*g, "idx"], "left").join(nxt, [*g, "idx"], "left")
    corner = ((F.col("_fp_next") - 2 * F.col("fps") + F.col("_fp_prev")) != 0) | \
             ((F.col("_tp_next") - 2 * F.col("tps") + F.col("_tp_prev")) != 0)
    keep = (F.col("_D") <= 2) | (F.col("idx") == 1) | (F.col("idx") == F.col("_D")) | corner
    kept = nb.where(keep).select(*g, "idx", "tps", "fps", "_s", "_P", "_N")
    # position among kept points (origin = 0)
    pos = prefix_sum(kept, g, "idx", {"_k": F.lit(1)}) \
        .select(*g, "idx", "tps", "fps", "_s", "_P", "_N", (F.col("_k")).cast("long").alias("pos"))
    n_kept = pos.groupBy(*g).agg(F.max("pos").alias("_K"), F.first("_P").alias("_P"), F.first("_N").alias("_N"))
    origin = n_kept.select(*g, F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("tps"), F.lit(0.0).alias("fps"),
                           F.lit(float("inf")).alias("_s"), "_P", "_N")
    pts = pos.select(*g, "pos", F.col("tps").cast("double"), F.col("fps").cast("double"), "_s", "_P", "_N") \
        .unionByName(origin)
    pts = pts.join(n_kept.select(*g, (F.col("_K") + 1).alias("_m")), g, "inner")
    picked = pts.where(_linspace_pick(F.col("pos"), F.col("_m"), max_points)) if max_points else pts
    return _finish(picked.select(*g, F.col("pos").alias("point"), F.col("_s").alias("threshold"),
                                 _ratio(F.col("fps"), F.col("_N")).alias("fpr"),
                                 _ratio(F.col("tps"), F.col("_P")).alias("tpr")), added)


def pr_points(scored: DataFrame | None, y: str, p: str, group_cols: list[str] | None = None,
              max_points: int | None = CURVE_POINTS, cum: DataFrame | None = None) -> DataFrame:
    """precision/recall at each distinct score from the highest down to the first score reaching
    full recall, listed from that point back to the top, then the (recall 0, precision 1) end;
    evenly sub-sampled to <= 50 points."""
    if cum is None:
        scored, g, added = _ensure_group(scored, group_cols)
        cs = cumulative_scores(scored, y, p, g)
    else:
        g, added, cs = list(group_cols), False, cum
    full_at = cs.where(F.col("tps") == F.col("_P")).groupBy(*g).agg(F.min("idx").alias("_last"))
    pts = cs.join(full_at, g, "inner")
    pts = pts.where(F.col("idx") <= F.col("_last")).select(
        *g, (F.col("_last") - F.col("idx")).alias("pos"), F.col("_s").alias("threshold"),
        _ratio(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
        _ratio(F.col("tps"), F.col("_P")).alias("recall"), "_last")
    end = full_at.select(*g, F.col("_last").alias("pos"), F.lit(None).cast("double").alias("threshold"),
                         F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), "_last")
    allp = pts.unionByName(end).withColumn("_m", F.col("_last") + 1)
    picked = allp.where(_linspace_pick(F.col("pos"), F.col("_m"), max_points)) if max_points else allp
    return _finish(picked.select(*g, F.col("pos").alias("point"), "threshold", "precision", "recall"), added)


def calibration_bins(scored: DataFrame, y: str, p: str, group_cols: list[str] | None = None,
                     n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """Uniform bins on [0, 1]; bin = number of inner edges strictly below p; empty bins absent."""
    g = list(group_cols or [])
    edges = [i * (1.0 / n_bins) for i in range(1, n_bins)]
    b = scored.select(*g, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"),
                      X.count_below(edges, F.col(p)).alias("bin"))
    return b.groupBy(*g, "bin").agg(F.avg("_y").alias("prob_true"), F.avg("_p").alias("prob_pred"),
                                    F.count(F.lit(1)).alias("n"))


def grid_values(n: int = CURVE_POINTS) -> list[float]:
    """n evenly spaced values on [0, 1] (j * 1/(n-1), last pinned to 1.0)."""
    step = 1.0 / (n - 1)
    return [j * step for j in range(n - 1)] + [1.0]


def interpolate_on_grid(points: DataFrame, group_cols: list[str], x: str, y: str, order: str,
                        n: int = CURVE_POINTS) -> DataFrame:
    """piecewise-linear y at each grid x (x non-decreasing along ``order``): the segment starts at
    the last point with x <= grid value and ends at the next point; beyond the last point the last y.

    Points are reduced per (group, grid cell) before any window, so the windows see at most n rows
    per group however long the curve is."""
    grid = grid_values(n)
    garr = F.array(*[F.lit(v) for v in grid])
    p = points.select(*group_cols, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(order).alias("_o")) \
        .withColumn("_k", X.count_below(grid, F.col("_x")))
    cells = p.groupBy(*group_cols, "_k").agg(
        F.max_by(F.struct("_x", "_y"), F.struct("_x", "_o")).alias("_last"),
        F.min_by(F.struct("_x", "_y"), F.col("_o")).alias("_first"))
    dense = points.select(*group_cols).distinct().select(*group_cols, F.posexplode(garr).alias("_k", "grid_x"))
    j = dense.join(cells, [*group_cols, "_k"], "left")
    w = Window.partitionBy(*group_cols).orderBy("_k")
    j = j.withColumn("_l", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))) \
         .withColumn("_r", F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    lx, ly, rx, ry = F.col("_l._x"), F.col("_l._y"), F.col("_r._x"), F.col("_r._y")
    val = F.when(F.col("_r").isNull() | (rx == lx), ly).otherwise((ry - ly) / (rx - lx) * (F.col("grid_x") - lx) + ly)
    return j.select(*group_cols, F.col("_k").alias("grid_index"), "grid_x", val.alias("value"))


def ovr_curves(scored_long: DataFrame, y: str, cls: str, p: str, per_class_points: int = 30,
               n: int = CURVE_POINTS) -> DataFrame:
    """Per-class ROC and PR curves (sub-sampled to ``per_class_points``) and the macro
    curves: mean interpolated TPR on an n-point FPR grid (first 0, last 1) and mean interpolated
    precision on an n-point recall grid.  Long output: curve, class, point, x, y."""
    b = scored_long.withColumn("_yb", (F.col(y).cast("string") == F.col(cls).cast("string")).cast("int"))
    has_pos = b.groupBy(cls).agg(F.max("_yb").alias("_hp")).where(F.col("_hp") == 1).select(cls)
    b = null_safe_join(b, has_pos, [cls] if isinstance(cls, str) else cls)  # one row per class
    cum = cumulative_scores(b, "_yb", p, [cls], materialize=True)
    roc = cut_lineage(roc_points(None, "_yb", p, [cls], max_points=None, cum=cum))
    pr = pr_points(None, "_yb", p, [cls], max_points=None, cum=cum)
    roc_sub = roc_points(None, "_yb", p, [cls], max_points=per_class_points, cum=cum)
    pr_sub = pr_points(None, "_yb", p, [cls], max_points=per_class_points, cum=cum)
    mroc = interpolate_on_grid(roc, [cls], "fpr", "tpr", "point", n) \
        .withColumn("value", F.when(F.col("grid_index") == 0, F.lit(0.0)).otherwise(F.col("value")))
    mroc = mroc.groupBy("grid_index", "grid_x").agg(F.avg("value").alias("value")) \
        .withColumn("value", F.when(F.col("grid_index") == n - 1, F.lit(1.0)).otherwise(F.col("value")))
    mpr = interpolate_on_grid(pr.withColumn("_rev", -F.col("point")), [cls], "recall", "precision", "_rev", n) \
        .groupBy("grid_index", "grid_x").agg(F.avg("value").alias("value"))
    c = F.col(cls).cast("string")
    return (roc_sub.select(F.lit("roc").alias("curve"), c.alias("class"), "point", F.col("fpr").alias("x"), F.col("tpr").alias("y"))
            .unionByName(pr_sub.select(F.lit("pr").alias("curve"), c.alias("class"), "point",
                                       F.col("recall").alias("x"), F.col("precision").alias("y")))
            .unionByName(mroc.select(F.lit("macro_roc").alias("curve"), F.lit(None).cast("string").alias("class"),
                                     F.col("grid_index").cast("long").alias("point"), F.col("grid_x").alias("x"),
                                     F.col("value").alias("y")))
            .unionByName(mpr.select(F.lit("macro_pr").alias("curve"), F.lit(None).cast("string").alias("class"),
                                    F.col("grid_index").cast("long").alias("point"), F.col("grid_x").alias("x"),
                                    F.col("value").alias("y"))))


# ---------------------------------------------------------------------------
# Label-based metrics
# ---------------------------------------------------------------------------

def confusion_counts(df: DataFrame, y: str, pred: str, group_cols: list[str] | None = None) -> DataFrame:
    """Long confusion matrix (actual, predicted, count); empty cells absent."""
    g = list(group_cols or [])
    return df.groupBy(*g, F.col(y).cast("string").alias("actual"), F.col(pred).cast("string").alias("predicted")) \
             .agg(F.count(F.lit(1)).alias("count"))


def classification_metrics(df: DataFrame, y: str, pred: str, group_cols: list[str] | None = None,
                           positive: str | None = "1") -> DataFrame:
    """Accuracy, balanced accuracy, macro precision/recall/F1, weighted F1 and, when
    ``positive`` is given, the positive-class precision/recall/F1/F2 and specificity.

    Macro averages run over the union of actual and predicted labels; balanced accuracy over
    actual labels (zero division -> 0)."""
    df, g, added = _ensure_group(df, group_cols)
    cc = confusion_counts(df, y, pred, g)
    per_actual = cc.groupBy(*g, F.col("actual").alias("label")).agg(
        F.sum("count").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count"))
                                               .otherwise(0)).alias("tp"))
    per_pred = cc.groupBy(*g, F.col("predicted").alias("label")).agg(F.sum("count").alias("predicted_n"))
    lab = per_actual.join(per_pred, [*g, "label"], "full").fillna(0, ["support", "tp", "predicted_n"])
    prec = _ratio(F.col("tp"), F.col("predicted_n"))
    rec = _ratio(F.col("tp"), F.col("support"))
    f1 = _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted_n"))
    agg = lab.groupBy(*g).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(F.col("support") > 0, rec)).alias("balanced_accuracy"),
        F.avg(prec).alias("precision_macro"), F.avg(rec).alias("recall_macro"), F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("n"))
    if positive is None:
        return _finish(agg, added)
    pos = lab.where(F.col("label") == positive).select(
        *g, F.col("tp").alias("_tp"), (F.col("predicted_n") - F.col("tp")).alias("_fp"),
        (F.col("support") - F.col("tp")).alias("_fn"))
    j = agg.join(pos, g, "left")
    tp, fp, fn = [F.coalesce(F.col(c), F.lit(0)) for c in ("_tp", "_fp", "_fn")]
    tn = F.col("n") - tp - fp - fn
    r = confusion_rates(tp, fp, fn, tn)
    return _finish(j.select(*g, "accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted",
                    r["precision"].alias("precision_positive"), r["recall"].alias("recall_positive"),
                    r["f1"].alias("f1_positive"), r["f2"].alias("f2_positive"), r["specificity"].alias("specificity"),
                    tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"),
                    tn.cast("long").alias("tn")), added)


def ovr_metrics(scored_long: DataFrame, y: str, cls: str, p: str, group_cols: list[str] | None = None) -> DataFrame:
    """One-vs-rest macro ROC-AUC and macro average precision.

    ``scored_long`` holds one row per (prediction, class) with the class score in ``p``; the
    binary label of a row is (actual == class)."""
    g = list(group_cols or [])
    b = scored_long.withColumn("_yb", (F.col(y).cast("string") == F.col(cls).cast("string")).cast("int"))
    per = ranking_metrics(b, "_yb", p, [*g, cls])
    return per.groupBy(*g).agg(F.avg("roc_auc").alias("macro_roc_auc"), F.avg("pr_auc").alias("macro_pr_auc"),
                               F.count(F.lit(1)).alias("n_classes"))


# ---------------------------------------------------------------------------
# Regression / forecasting
# ---------------------------------------------------------------------------

RESIDUAL_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def regression_metrics(df: DataFrame, y: str, pred: str, group_cols: list[str] | None = None,
                       forecast: bool = False) -> DataFrame:
    """E17 (+E18 when ``forecast``): mae, mse, rmse, r2, median_ae, mape %, max_residual,
    residual p10/p25/p50/p75/p90 (linear), and wape % / smape %."""
    df, g, added = _ensure_group(df, group_cols)
    yy, pp = F.col(y).cast("double"), F.col(pred).cast("double")
    r = yy - pp
    base = df.select(*g, yy.alias("_y"), pp.alias("_p"), r.alias("_r"))
    ry, rp, rr = F.col("_y"), F.col("_p"), F.col("_r")
    mape_t = F.abs(rr / F.when(ry == 0, F.lit(1e-6)).otherwise(ry))
    smape_den = F.abs(ry) + F.abs(rp)
    moments = base.groupBy(*g).agg(
        F.avg(F.abs(rr)).alias("mae"), F.avg(rr * rr).alias("mse"), F.sum(rr * rr).alias("_sse"),
        F.count(F.lit(1)).alias("n"), F.avg(ry).alias("_ybar"), F.var_pop(ry).alias("_vy"),
        (F.avg(mape_t) * 100.0).alias("mape"), F.max(F.abs(rr)).alias("max_residual"),
        F.sum(F.abs(rr)).alias("_sabs"), F.sum(F.abs(ry)).alias("_sy"),
        (F.avg(F.when(smape_den == 0, F.lit(0.0)).otherwise(2.0 * F.abs(rr) / smape_den)) * 100.0).alias("smape"))
    sst = F.col("_vy") * F.col("n")
    r2 = F.when(sst == 0, F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("_sse") / sst)
    quant = exact_quantiles(base.select(*g, "_r"), g, "_r", RESIDUAL_PROBS)
    qw = quant.groupBy(*g).agg(*[F.max(F.when(F.col("p") == pr, F.col("q"))).alias(f"residual_p{int(pr * 100)}")
                                 for pr in RESIDUAL_PROBS])
    med = exact_quantiles(base.select(*g, F.abs(rr).alias("_a")), g, "_a", [0.5]).select(*g, F.col("q").alias("median_ae"))
    out = moments.join(qw, g, "inner").join(med, g, "inner")
    cols = [*g, "n", "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "median_ae", "mape", "max_residual",
            *[f"residual_p{int(pr * 100)}" for pr in RESIDUAL_PROBS]]
    if forecast:
        cols += [F.when(F.col("_sy") > 0, F.col("_sabs") / F.col("_sy") * 100.0).otherwise(0.0).alias("wape"), "smape"]
    return _finish(out.select(*cols), added)


def cv_summary(fold_scores: DataFrame, group_cols: list[str], score: str) -> DataFrame:
    """Mean and population std of fold scores per group."""
    return fold_scores.groupBy(*group_cols).agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"),
                                                F.count(F.lit(1)).alias("n_folds"))


def registry_score(task: Column, metrics: Column) -> tuple[Column, Column]:
    """(metric name, score in [0, 1]) from a map<string,double> of holdout metrics."""
    def ok(k):
        v = metrics[k]
        return v.isNotNull() & (v >= 0) & (v <= 1)
    f1 = F.coalesce(F.when(metrics["f1_positive"] != 0, metrics["f1_positive"]),
                    F.when(metrics["f1_macro"] != 0, metrics["f1_macro"]), metrics["f1"])
    cls = F.lower(F.coalesce(task, F.lit("classification"))) == "classification"
    wape = metrics["wape"]
    wfrac = F.when(wape > 1, wape / 100.0).otherwise(wape)
    name = (F.when(cls, F.when(ok("roc_auc"), "Holdout ROC-AUC").when(ok("balanced_accuracy"), "Holdout Balanced Accuracy")
                   .when(ok("accuracy"), "Holdout Accuracy").when(ok("pr_auc"), "Holdout PR-AUC")
                   .when(f1.isNotNull() & (f1 >= 0) & (f1 <= 1), "Holdout F1-Score").otherwise("Holdout Score"))
            .otherwise(F.when(metrics["r2"].isNotNull(), "Holdout R2").when(wape.isNotNull(), "Holdout Accuracy (1-WAPE)")
                       .otherwise("Holdout Score")))
    score = (F.when(cls, F.when(ok("roc_auc"), metrics["roc_auc"]).when(ok("balanced_accuracy"), metrics["balanced_accuracy"])
                    .when(ok("accuracy"), metrics["accuracy"]).when(ok("pr_auc"), metrics["pr_auc"])
                    .when(f1.isNotNull() & (f1 >= 0) & (f1 <= 1), f1).otherwise(0.5))
             .otherwise(F.when(metrics["r2"].isNotNull(), F.greatest(F.lit(0.0), F.least(metrics["r2"], F.lit(1.0))))
                        .when(wape.isNotNull(), F.greatest(F.lit(0.0), F.least(1 - wfrac, F.lit(1.0))))
                        .otherwise(0.5)))
    return name, F.round(score, 4)
