"""End-to-end analysis run (Z2), benchmark sweep (Z3) and the evidence lookup.

A plain driver function calling the operators; each stage yields DataFrames.  Work is
materialised (reliable checkpoint) only where several later stages re-read it: the
cleaned table and each candidate's out-of-fold predictions.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.functions import exprs as X
from tabsight.operators import classify, critic, evidence, explain, features, metrics as M, models, preprocess as PP
from tabsight.operators import quality, split as SP, stats
from tabsight.session import cut_lineage

KEY = "_row_key"


@dataclass
class AnalysisResult:
    analysis_id: str
    task: dict
    column_stats: DataFrame
    alerts: DataFrame
    leaks: DataFrame
    dropped_columns: list
    experiments: DataFrame
    leaderboard: DataFrame
    findings: DataFrame
    status: DataFrame
    holdout: DataFrame
    importance: DataFrame | None
    insights: DataFrame
    champion: str | None
    runtime_sec: float = 0.0
    extra: dict = field(default_factory=dict)


def _with_key(df: DataFrame) -> DataFrame:
    """Deterministic row key: md5 of the row's JSON (rows are unique after de-duplication)."""
    return df.withColumn(KEY, F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))


def _experiment_rows(spark, exps, analysis_id, task, validation, target, raw_cols, remediated):
    rows = []
    for e in exps:
        cv_rmse = e.cv_mean if task == "regression" else None
        rows.append((f"{analysis_id}:{e.name}", analysis_id, e.name, e.family, task, validation, target,
                     e.cv_mean, e.cv_std, cv_rmse, e.train_time_sec, {k: v for k, v in e.train_metrics.items() if v is not None},
                     {}, e.preprocessor.feature_names if e.preprocessor else [], raw_cols, remediated, e.threshold))
    schema = ("experiment_id string, analysis_id string, model_name string, model_family string, problem_type string, "
              "validation_strategy string, target_column string, cv_mean double, cv_std double, cv_rmse double, "
              "train_time_sec double, train map<string,double>, test map<string,double>, feature_names array<string>, "
              "raw_columns array<string>, remediated array<string>, threshold double")
    # one row per candidate model
    return spark.createDataFrame(rows, schema).withColumn("task_type", F.col("problem_type"))


def run_analysis(spark: SparkSession, df: DataFrame, goal: str = "", target: str | None = None,
                 time_col: str | None = None, problem_type: str | None = None, candidates: list[str] | None = None,
                 folds: int = 3, test_size: float = 0.2, retrain_on_leak: bool = True,
                 group_cols: list[str] | None = None) -> AnalysisResult:
    """``group_cols``: for forecasting, the columns that name a series (Q4); a time that occurs twice in a series is an error."""
    t0 = time.time()
    timings: dict[str, float] = {}
    mark = [time.time()]

    def lap(name: str) -> None:
        now = time.time()
        timings[name] = round(now - mark[0], 2)
        mark[0] = now
    aid = uuid.uuid4().hex[:12]
    df = cut_lineage(df)  # profile, leaks, alerts and cleaning read it many times
    cs = stats.column_stats(df)
    task_row = classify.decide_task(df, target, time_col, goal, col_stats=cs).first().asDict()
    if problem_type:
        task_row["problem_type"] = problem_type
    task = task_row["problem_type"]
    target = task_row["target_column"]
    time_col = task_row["time_column"]
    leaks = quality.leakage_columns(df, target) if target else spark.createDataFrame([], "column string, reason string, partner string, explanation string")
    leaks = cut_lineage(leaks)
    alerts = quality.quality_alerts(df, target, cs, leaks)
    lap("profile_task_leakage")
    empty = spark.createDataFrame([], "x int")
    if task == "eda" or not target:  # Q10: stop after profile and alerts
        return AnalysisResult(aid, task_row, cs, alerts, leaks, [], empty, empty, empty, empty, empty, None, empty, None,
                              time.time() - t0)

    # rows without a label can't be learnt from or judged: they go before the split, with an alert that counts them
    alerts = alerts.unionByName(PP.missing_labels(df, target))
    cleaned, dropped = quality.clean_dataset(df.where(~X.is_missing(target, df.schema[target].dataType)), target, leaks=leaks)
    remediated = [c for c in dropped if c in {r["column"] for r in leaks.collect()}]
    labels: list[str] = []
    if task == "forecasting":
        keys = list(group_cols or [])
        if dict(cleaned.dtypes)[time_col] == "string":
            cleaned = cleaned.withColumn(time_col, X.parse_datetime(F.col(time_col)))
        cleaned = cleaned.where(F.col(time_col).isNotNull() & F.col(target).isNotNull())
        if not features.series_are_keyed(cleaned, time_col, keys):
            raise ValueError(f"{time_col} repeats within a series: name the columns of a series with group_cols")
        base = features.lag_features(cleaned, time_col, target, keys).withColumn("label", F.col(target).cast("double"))
        base = base.withColumn(models.NAIVE, F.coalesce("target_lag_7", "target_lag_1").cast("double"))
        base = cut_lineage(_with_key(base.drop(target)))
        sp = features.chronological_split(base, time_col, KEY, test_size)
        exclude = [KEY, "label", time_col, "split", models.NAIVE]
        validation = "walk_forward_time_split"
        n_classes = 0
    else:
        keyed = _with_key(cleaned)
        if task == "classification":
            keyed, labels = PP.encode_labels(keyed, target, "label")
            n_classes = len(labels)
        else:
            keyed = keyed.withColumn("label", F.col(target).cast("double"))
            n_classes = 0
        keyed = cut_lineage(keyed.drop(target))
        sp = SP.holdout_split(keyed, KEY, "label" if task == "classification" else None, test_size)
        exclude = [KEY, "label", "split"]
        validation = "stratified_kfold" if task == "classification" else "kfold"
    sp = cut_lineage(sp)
    lap("clean_split")
    train, test = sp.where(F.col("split") == "train").drop("split"), sp.where(F.col("split") == "test").drop("split")
    numeric, categorical = PP.split_columns(train, exclude)
    cand = candidates or models.DEFAULT_CANDIDATES[task]

    def train_all(num, cat, suffix=""):
        from concurrent.futures import ThreadPoolExecutor
        cv = models.prepare_cv(train, KEY, num, cat, task, folds, time_col=time_col if task == "forecasting" else None)
        lap("prepare_folds" + suffix)
        # candidates are independent: their Spark jobs are submitted concurrently
        with ThreadPoolExecutor(max_workers=len(cand)) as ex:
            return list(ex.map(lambda c: models.train_candidate(c + suffix, task, cv, n_classes, labels, goal), cand))

    exps = train_all(numeric, categorical)
    folds_used = [r["fold"] for r in exps[0].cv_scores.select("fold").distinct().collect()] if exps[0].cv_scores is not None else []
    lap("cv_portfolio")
    raw_cols = [c for c in df.columns]
    exp_df = _experiment_rows(spark, exps, aid, task, validation, target, raw_cols, remediated)
    findings = critic.critique(exp_df)
    status = critic.audit_status(exp_df, findings)
    # One leak-free retrain when the critic asks for it
    leak_cols = sorted({r["affected_components"][0] for r in findings.where(F.col("action") == "REMOVE_LEAKY_FEATURES").collect()})
    if retrain_on_leak and leak_cols:
        numeric = [c for c in numeric if c not in leak_cols]
        categorical = [c for c in categorical if c not in leak_cols]
        train = train.drop(*leak_cols)
        test = test.drop(*leak_cols)
        remediated = remediated + leak_cols
        exps2 = train_all(numeric, categorical, "_LeakFree")
        exp_df = exp_df.unionByName(_experiment_rows(spark, exps2, aid, task, validation, target, raw_cols, remediated))  # U4
        exps = exps2
        # the retrained candidates are criticised like the first ones
        retrained = exp_df.where(F.col("model_name").isin([e.name for e in exps]))
        findings = findings.unionByName(critic.critique(retrained))
    lap("critic_retrain")
    board = evidence.leaderboard(exp_df.where(F.col("model_name").isin([e.name for e in exps])), score_col="cv_mean")
    champ_name = board.where(F.col("rank") == 1).first()["model_name"]
    champ = [e for e in exps if e.name == champ_name][0]
    default, locked, pred = models.evaluate_holdout(champ, test, KEY)
    hold_rows = [("default_0.50", k, v) for k, v in default.items() if v is not None]
    if locked:
        hold_rows += [("locked_threshold", k, v) for k, v in locked.items() if v is not None]
    holdout = spark.createDataFrame(hold_rows, "cutoff string, metric_name string, metric_value double")
    # R0 again after the holdout (Q15): the critic now sees test metrics
    test_map = {k: v for k, v in (locked or default).items() if v is not None}
    post = exp_df.where(F.col("model_name") == champ_name).withColumn(
        "test", F.create_map(*[x for k, v in test_map.items() for x in (F.lit(k), F.lit(float(v)))]))
    findings = critic.critique(post).unionByName(findings.join(post.select("experiment_id"), "experiment_id", "left_anti"))
    status = critic.audit_status(exp_df, findings)
    lap("holdout_critic")
    imp = explain.native_importance(spark, champ)
    facts = _insight_facts(spark, task, default, locked, imp, alerts)
    return AnalysisResult(aid, task_row, cs, alerts, leaks, dropped, exp_df, board, findings, status, holdout, imp,
                          evidence.insight_rows(facts), champ_name, time.time() - t0,
                          {"predictions": pred, "experiments": exps, "timings": timings, "validation": validation,
                           "folds": len(folds_used)})


def _insight_facts(spark, task, default, locked, imp, alerts) -> DataFrame:
    """G5 inputs: computed numbers phrased per pillar (small: a few rows)."""
    rows = []
    n_crit = alerts.where(F.col("severity") == "critical").count()
    rows.append(("observed", f"{n_crit} critical data-quality alert(s) were raised before modelling."))
    top = imp.orderBy("rank").select("feature", "importance_pct").limit(3).collect() if imp is not None else []
    if top:
        rows.append(("model_derived", "Top drivers: " + ", ".join(f"{r['feature']} ({r['importance_pct']:.1f}%)" for r in top)))
    if task == "classification" and locked:
        rows.append(("recommendation", f"Operate at cutoff {locked['threshold']:.2f}: recall "
                                       f"{locked.get('recall_positive', 0) * 100:.1f}% vs {default.get('recall_positive', 0) * 100:.1f}% at 0.50."))
    if task != "classification" and default.get("rmse") is not None:
        rows.append(("limitation", f"Holdout RMSE {default['rmse']:.3f}; errors are larger on extreme values."))
    return spark.createDataFrame(rows, "pillar string, text string")


def benchmark_sweep(spark: SparkSession, datasets: list[tuple[str, DataFrame, str | None, str]]) -> DataFrame:
    """Z3: run Z2 per dataset; one row each (rows, cols, runtime, champion, score, audit status)."""
    rows = []
    for name, df, target, goal in datasets:
        t0 = time.time()
        r = run_analysis(spark, df, goal, target)
        n = df.count()
        hold = {x["metric_name"]: x["metric_value"] for x in r.holdout.where(F.col("cutoff") == "default_0.50").collect()} \
            if r.champion else {}
        score = hold.get("roc_auc") or hold.get("accuracy") or hold.get("r2")
        st = r.status.where(F.col("experiment_id").endswith(":" + (r.champion or ""))).first() if r.champion else None
        rows.append((name, n, len(df.columns), r.task["problem_type"], r.champion, score,
                     st["audit_status"] if st else None, time.time() - t0))
    # one row per dataset
    return spark.createDataFrame(rows, "dataset string, rows long, cols long, problem_type string, champion string, "
                                       "holdout_score double, audit_status string, runtime_sec double")
