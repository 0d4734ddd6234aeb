"""Methodology critic (R0-R10): rule selects over an experiments table -> finding rows -> status.

Experiments table columns: experiment_id, model_name, problem_type, validation_strategy,
target_column, cv_mean double, cv_rmse double (nullable), train map<string,double>,
test map<string,double> (empty before the holdout), feature_names array<string>,
raw_columns array<string>, remediated array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabsight.functions import exprs as X

FINDING_COLS = ["experiment_id", "issue_type", "severity", "description", "affected_components", "remediation", "action"]
# Fixed rule thresholds.
SEVERE_TRAIN = 0.98
SEVERE_EVAL = 0.82
GAP = 0.15
RMSE_RATIO = 1.8
SUSPICIOUS_AUC = 0.995
BRIER_MAX = 0.20


def _get(m: str, k: str, default: float | None = 0.0) -> Column:
    v = F.col(m)[k]
    return F.coalesce(v, F.lit(default)) if default is not None else v


def _has_test() -> Column:
    return F.size(F.map_keys("test")) > 0


def _finding(df: DataFrame, cond: Column, issue: str, severity: str, desc: Column, comps: Column, remedy: str,
             action: str | None = None) -> DataFrame:
    return df.where(cond).select("experiment_id", F.lit(issue).alias("issue_type"), F.lit(severity).alias("severity"),
                                 desc.alias("description"), comps.alias("affected_components"),
                                 F.lit(remedy).alias("remediation"), F.lit(action).cast("string").alias("action"))


def critique(experiments: DataFrame) -> DataFrame:
    """One row per finding."""
    e = experiments
    cls = F.col("problem_type") == "classification"
    reg = F.col("problem_type").isin("regression", "forecasting")
    train_s = F.coalesce(F.col("train")["roc_auc"], F.col("train")["accuracy"], F.lit(0.0))
    test_s = F.coalesce(F.col("test")["roc_auc"], F.col("test")["accuracy"], F.lit(0.0))
    eval_s = F.when(~_has_test() & (F.coalesce("cv_mean", F.lit(0.0)) > 0), F.col("cv_mean")).otherwise(test_s)
    gap = train_s - eval_s
    model = F.array("model_name")
    parts = [
        _finding(e, cls & (train_s >= SEVERE_TRAIN) & (eval_s < SEVERE_EVAL) & (eval_s > 0), "severe_overfitting",
                 "critical", F.format_string("Generalisation gap %.3f (train %.3f, eval %.3f).", gap, train_s, eval_s),
                 model, "Regularise the model (shallower trees, stronger penalty).", "REGULARIZE_MODEL"),
        _finding(e, cls & ~((train_s >= SEVERE_TRAIN) & (eval_s < SEVERE_EVAL) & (eval_s > 0)) & (gap > GAP) & (eval_s > 0),
                 "moderate_overfitting", "warning",
                 F.format_string("Train-validation gap %.3f (train %.3f, eval %.3f).", gap, train_s, eval_s),
                 model, "Tune capacity or stop earlier to close the gap."),
    ]
    tr_rmse = _get("train", "rmse")
    ev_rmse = F.when(_has_test(), _get("test", "rmse")).otherwise(
        F.coalesce(F.col("cv_rmse"), F.when(F.col("problem_type") == "regression", F.col("cv_mean")), F.lit(0.0)))
    parts.append(_finding(e, reg & (tr_rmse > 0) & (ev_rmse > 0) & (ev_rmse / tr_rmse > RMSE_RATIO),
                          "severe_overfitting", "critical",
                          F.format_string("Evaluation RMSE %.2f is %.1fx the train RMSE %.2f.", ev_rmse, ev_rmse / tr_rmse, tr_rmse),
                          model, "Shrink coefficients, prune trees or reduce the feature space.", "REGULARIZE_MODEL"))
    raw = e.select("*", F.explode_outer("raw_columns").alias("_raw"))
    in_feats = F.exists("feature_names", lambda f: (F.lower(f) == F.lower(F.col("_raw"))) |
                        (F.instr(F.lower(f), F.lower(F.col("_raw"))) > 0))
    parts.append(_finding(raw, F.col("_raw").isNotNull() & (F.col("_raw") != F.coalesce("target_column", F.lit(""))) &
                          X.post_outcome(F.col("_raw")) & in_feats, "domain_target_leakage", "critical",
                          F.format_string("Feature '%s' holds information unknown at prediction time.", F.col("_raw")),
                          F.array("_raw"), "Drop the feature and retrain the candidates.", "REMOVE_LEAKY_FEATURES"))
    rem = e.select("*", F.explode_outer("remediated").alias("_rem"))
    parts.append(_finding(rem, F.col("_rem").isNotNull(), "target_component_leakage_remediated", "info",
                          F.format_string("Leakage prevention excluded '%s' before training.", F.col("_rem")),
                          F.array("_rem"), "Excluded from the feature matrix before training."))
    parts.append(_finding(e, cls & (_get("test", "roc_auc") >= SUSPICIOUS_AUC), "suspicious_performance", "warning",
                          F.format_string("ROC-AUC %.4f is unusually high; look for target proxies.", _get("test", "roc_auc")),
                          model, "Audit feature correlations and attributions for proxies."))
    vs = F.lower(F.coalesce("validation_strategy", F.lit("")))
    parts.append(_finding(e, (F.col("problem_type") == "forecasting") & vs.contains("kfold") & ~vs.contains("time") &
                          ~vs.contains("walk"), "improper_validation", "critical",
                          F.format_string("Random k-fold (%s) on time-ordered data leaks the future.", F.col("validation_strategy")),
                          F.array(F.lit("validation_pipeline")), "Use walk-forward (expanding window) validation.",
                          "SWITCH_VALIDATION_STRATEGY"))
    parts.append(_finding(e, cls & (_get("test", "is_binary") == 1.0) & (_get("test", "brier_score") > BRIER_MAX),
                          "poor_calibration", "warning",
                          F.format_string("Brier score %.3f: probabilities are poorly calibrated.", _get("test", "brier_score")),
                          model, "Calibrate on validation predictions (isotonic or Platt)."))
    parts.append(_finding(e, cls & (_get("test", "is_imbalanced") == 1.0), "class_imbalance_accuracy_hazard", "warning",
                          F.format_string("Positive prevalence %.1f%%; accuracy %.1f%% while recall is %.1f%%.",
                                          _get("test", "prevalence") * 100, _get("test", "accuracy") * 100,
                                          _get("test", "recall_positive") * 100),
                          F.array(F.lit("evaluation_metrics"), F.col("model_name")),
                          "Tune the decision threshold; report PR-AUC, ROC-AUC, F1 and F2."))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_status(experiments: DataFrame, findings: DataFrame) -> DataFrame:
    """Per experiment: status, requires_iteration and the sorted set of actions."""
    agg = findings.groupBy("experiment_id").agg(
        F.bool_or(F.col("severity") == "critical").alias("_crit"),
        F.bool_or(F.col("severity") == "warning").alias("_warn"),
        F.array_sort(F.collect_set("action")).alias("actions"))
    j = experiments.select("experiment_id", (F.size(F.coalesce("remediated", F.array())) > 0).alias("_rem")) \
        .join(agg, "experiment_id", "left")
    status = (F.when(F.coalesce("_crit", F.lit(False)), "CRITICAL_ISSUES_FOUND")
               .when(F.col("_rem"), "PASSED (Remediated)")
               .when(F.coalesce("_warn", F.lit(False)), "WARNINGS_IDENTIFIED").otherwise("PASSED"))
    return j.select("experiment_id", status.alias("audit_status"),
                    F.coalesce(F.size("actions") > 0, F.lit(False)).alias("requires_iteration"),
                    F.coalesce("actions", F.array().cast("array<string>")).alias("actions"))
