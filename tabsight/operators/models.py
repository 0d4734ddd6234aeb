"""Model portfolio, cross-validation and holdout evaluation.

Every estimator is a ``pyspark.ml`` estimator (distributed fit, row-parallel
scoring); the driver only loops over folds and candidates.  Out-of-fold
predictions are the union of the fold transforms, keyed by the row key, and are
written once (reliable checkpoint) because thresholds, curves and fold scores all
read them.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.operators import features as FE, forest, metrics as M
from tabsight.operators import preprocess as PP
from tabsight.operators import split as SP
from tabsight.session import cut_lineage

# Candidate aliases (lower-case, '_'/'-' removed) -> (family, preset), and default plans.
ALIASES = {
    "classification": {
        "dummy": "baseline", "baseline": "baseline", "dummyclassifier": "baseline",
        "logisticregression": "logistic", "logistic": "logistic", "lr": "logistic", "linear": "logistic",
        "linearclassifier": "logistic", "ridgeclassifier": "logistic",
        "randomforest": "random_forest", "rf": "random_forest", "randomforestclassifier": "random_forest",
        "lightgbm": "gbt_lgbm", "lgbm": "gbt_lgbm", "lightgbmclassifier": "gbt_lgbm",
        "xgboost": "gbt_xgb", "xgb": "gbt_xgb", "xgboostclassifier": "gbt_xgb",
        "gradientboosting": "gbt_gbm", "gbm": "gbt_gbm", "gradientboostingclassifier": "gbt_gbm",
    },
    "regression": {
        "dummy": "baseline", "baseline": "baseline", "dummyregressor": "baseline",
        "ridge": "ridge", "linearregression": "ridge", "linear": "ridge", "linearregressor": "ridge",
        "randomforest": "random_forest", "rf": "random_forest", "randomforestregressor": "random_forest",
        "lightgbm": "gbt_lgbm", "lgbm": "gbt_lgbm", "lightgbmregressor": "gbt_lgbm",
        "xgboost": "gbt_xgb", "xgb": "gbt_xgb", "xgboostregressor": "gbt_xgb",
        "gradientboosting": "gbt_gbm", "gbm": "gbt_gbm", "gradientboostingregressor": "gbt_gbm",
        "seasonalnaive": "seasonal_naive",
    },
}
PRESETS = {
    "random_forest": {"numTrees": 100, "maxDepth": 10},
    "gbt_lgbm": {"maxIter": 120, "stepSize": 0.05, "maxDepth": 6},
    "gbt_xgb": {"maxIter": 120, "stepSize": 0.05, "maxDepth": 6},
    "gbt_gbm": {"maxIter": 100, "stepSize": 0.05, "maxDepth": 5},
    "logistic": {"C": 1.0, "maxIter": 1000},
    "ridge": {"alpha": 1.0},
}
FAMILIES = {"baseline": "baseline", "logistic": "linear", "ridge": "linear", "random_forest": "random_forest",
            "gbt_lgbm": "gradient_boosting", "gbt_xgb": "gradient_boosting", "gbt_gbm": "gradient_boosting",
            "seasonal_naive": "seasonal_naive"}
DEFAULT_CANDIDATES = {
    "classification": ["LightGBM", "RandomForest", "LogisticRegression", "Baseline"],
    "regression": ["LightGBM", "RandomForest", "Ridge", "Baseline"],
    "forecasting": ["LightGBM", "RandomForest", "Seasonal_Naive"],
}
# Column of forecast frames: the value one season earlier, or the latest known one.
NAIVE = "_naive"
RETRAIN_SUFFIXES = ("_leakfree", "_lagged")


def resolve_model(name: str, task: str) -> tuple[str, str, dict]:
    """M0: (preset, family, params) for a candidate name; unknown names raise (Q1, Q2)."""
    t = "classification" if task == "classification" else "regression"
    if task not in ("classification", "regression", "forecasting"):
        raise ValueError(f"Unsupported problem type: {task}")
    base = name.lower()
    for suf in RETRAIN_SUFFIXES:
        if base.endswith(suf):
            base = base[: -len(suf)]
    key = base.replace("_", "").replace("-", "").strip()
    preset = ALIASES[t].get(key)
    if preset is None:
        raise ValueError(f"Unknown model '{name}' for {task}")
    return preset, FAMILIES[preset], dict(PRESETS.get(preset, {}))


@dataclass
class FittedModel:
    preset: str
    task: str
    n_classes: int
    stages: list = field(default_factory=list)  # fitted Spark ML models (one per class for multiclass GBT)
    constants: dict = field(default_factory=dict)  # baseline priors / mean

    def predict(self, feats: DataFrame) -> DataFrame:
        """Adds ``prediction`` (label index or value) and, for classification, ``p`` (positive-class
        probability, binary) and ``probs`` (array of class probabilities)."""
        if self.preset == "seasonal_naive":
            return feats.withColumn("prediction", F.col(NAIVE))
        if self.preset == "baseline":
            if self.task == "classification":
                pri = self.constants["priors"]
                arr = F.array(*[F.lit(float(x)) for x in pri])
                best = max(range(len(pri)), key=lambda i: (pri[i], -i))
                out = feats.withColumn("probs", arr).withColumn("prediction", F.lit(float(best)))
            else:
                return feats.withColumn("prediction", F.lit(float(self.constants["mean"])))
        elif self.task == "classification" and self.preset.startswith("gbt") and self.n_classes > 2:
            out = feats
            for c, m in enumerate(self.stages):
                out = m.transform(out).withColumn(f"_pc{c}", vector_to_array("probability")[1]) \
                    .drop("rawPrediction", "probability", "prediction")
            tot = sum((F.col(f"_pc{c}") for c in range(self.n_classes)), F.lit(0.0))
            out = out.withColumn("probs", F.array(*[F.col(f"_pc{c}") / tot for c in range(self.n_classes)])) \
                     .drop(*[f"_pc{c}" for c in range(self.n_classes)])
            best = F.array_position(F.col("probs"), F.array_max("probs")) - 1
            out = out.withColumn("prediction", best.cast("double"))
        else:
            out = self.stages[0].transform(feats)
            if self.task != "classification":
                return out.drop(*[c for c in ("rawPrediction",) if c in out.columns])
            out = out.withColumn("probs", vector_to_array("probability")).drop("rawPrediction", "probability")
        if self.n_classes == 2:
            out = out.withColumn("p", F.col("probs")[1])
        return out


def fit_model(preset: str, task: str, train_feats: DataFrame, n_classes: int, seed: int = 42) -> FittedModel:
    """Fits one estimator on (features, label)."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    fm = FittedModel(preset, task, n_classes)
    params = PRESETS.get(preset, {})
    if preset == "baseline":
        if task == "classification":
            counts = {int(r["label"]): r["n"] for r in train_feats.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
            tot = sum(counts.values())
            fm.constants["priors"] = [counts.get(i, 0) / tot for i in range(n_classes)]
        else:
            fm.constants["mean"] = train_feats.agg(F.avg("label")).first()[0]
        return fm
    if preset == "seasonal_naive":
        return fm  # nothing to fit: the value one season earlier is a column of the feature frame
    n = train_feats.count()
    if task == "classification":
        if preset == "logistic":
            est = C.LogisticRegression(regParam=1.0 / (params["C"] * n), elasticNetParam=0.0, standardization=False,
                                       maxIter=params["maxIter"], family="multinomial" if n_classes > 2 else "binomial")
        elif preset == "random_forest":
            est = C.RandomForestClassifier(numTrees=params["numTrees"], maxDepth=params["maxDepth"], seed=seed)
        else:
            if n_classes > 2:  # Spark GBT is binary: one model per class, probabilities normalised
                for c in range(n_classes):
                    d = train_feats.withColumn("label", (F.col("label") == c).cast("double"))
                    fm.stages.append(C.GBTClassifier(maxIter=params["maxIter"], stepSize=params["stepSize"],
                                                     maxDepth=params["maxDepth"], seed=seed).fit(d))
                return fm
            est = C.GBTClassifier(maxIter=params["maxIter"], stepSize=params["stepSize"], maxDepth=params["maxDepth"],
                                  seed=seed)
    else:
        if preset == "ridge":
            sd = train_feats.agg(F.stddev_samp("label")).first()[0] or 1.0
            est = R.LinearRegression(solver="l-bfgs", regParam=params["alpha"] / n * sd, elasticNetParam=0.0,
                                     standardization=False, maxIter=1000)
        elif preset == "random_forest":
            model = forest.fit(train_feats, n, params["numTrees"], params["maxDepth"], seed)
            if model is not None:
                fm.stages.append(model)
                return fm
            est = R.RandomForestRegressor(numTrees=params["numTrees"], maxDepth=params["maxDepth"], seed=seed)
        else:
            est = R.GBTRegressor(maxIter=params["maxIter"], stepSize=params["stepSize"], maxDepth=params["maxDepth"],
                                 seed=seed)
    fm.stages.append(est.fit(train_feats))
    return fm


def class_scores(pred: DataFrame, n_classes: int, keep: list[str]) -> DataFrame:
    """One row per (prediction, class) with the class's probability ``p``."""
    return pred.select(*keep, F.col("label").cast("int").alias("label"), F.posexplode("probs").alias("class_id", "p")) \
               .where(F.col("class_id") < n_classes)


def _fold_score(task: str, pred: DataFrame, n_classes: int) -> DataFrame:
    """M8: per fold score: ROC-AUC (binary), macro one-vs-rest ROC-AUC (multiclass; accuracy in a fold where
    no class has both members and others) / RMSE / WAPE."""
    if task == "classification":
        if n_classes == 2:
            return M.ranking_metrics(pred, "label", "p", ["fold"]).select("fold", F.col("roc_auc").alias("score"))
        acc = M.classification_metrics(pred, "label", "prediction", ["fold"], positive=None).select("fold", "accuracy")
        ovr = M.ovr_metrics(class_scores(pred, n_classes, ["fold"]), "label", "class_id", "p", ["fold"]).select("fold", "macro_roc_auc")
        return acc.join(ovr, "fold", "left").select("fold", F.coalesce("macro_roc_auc", "accuracy").alias("score"))
    r = M.regression_metrics(pred, "label", "prediction", ["fold"], forecast=(task == "forecasting"))
    return r.select("fold", F.col("wape" if task == "forecasting" else "rmse").alias("score"))


@dataclass
class Experiment:
    name: str
    preset: str
    family: str
    task: str
    params: dict
    numeric: list
    categorical: list
    n_classes: int
    labels: list
    cv_scores: DataFrame | None = None
    cv_mean: float | None = None
    cv_std: float | None = None
    oof: DataFrame | None = None
    train_metrics: dict = field(default_factory=dict)
    threshold: float | None = None
    train_time_sec: float = 0.0
    preprocessor: PP.Preprocessor | None = None
    model: FittedModel | None = None


def _feats(pp: PP.Preprocessor, df: DataFrame, key: str) -> DataFrame:
    return pp.transform(df).select(key, "label", "features", *[c for c in ("fold", NAIVE) if c in df.columns])


@dataclass
class PreparedCV:
    """Fold-safe feature sets shared by every candidate: per fold the training/validation vectors from a
    preprocessor fitted on that fold's training rows only (X6), plus the full-train preprocessor."""
    key: str
    numeric: list
    categorical: list
    folds: list  # [(train_feats, valid_feats)]
    full: PP.Preprocessor
    full_feats: DataFrame
    n_rows: int


ROWS_PER_PARTITION = 100_000


def _sized(df: DataFrame, n_rows: int) -> DataFrame:
    """Partition count from the row count: iterative learners launch several jobs per iteration, and
    tasks over near-empty partitions only add scheduling overhead; large inputs keep one partition
    per ~100k rows (full parallelism on a cluster)."""
    parts = max(1, -(-n_rows // ROWS_PER_PARTITION))
    return df.repartition(parts) if parts > 1 else df.coalesce(1)


def prepare_cv(train: DataFrame, key: str, numeric: list[str], categorical: list[str], task: str,
               folds: int = 3, parallelism: int = 4, time_col: str | None = None) -> PreparedCV:
    """Fold ids (X10: stratified for classification; X11: expanding windows over ``time_col`` for forecasting) ->
    per-fold preprocessing -> written feature sets."""
    from concurrent.futures import ThreadPoolExecutor
    n = train.count()
    prepared = []
    fit = PP.fit_ordinal if task == "forecasting" else PP.fit_preprocessor
    if SP.cv_allowed(n, folds) and time_col:
        wf = cut_lineage(FE.walk_forward_folds(train, time_col, folds))

        def window(i):
            own = wf.where(F.col("fold") == i)
            tr, va = own.where("role = 'train'"), own.where("role = 'validation'")
            pp = fit(tr, numeric, categorical)
            share = n // (folds + 1) + 1
            return cut_lineage(_sized(_feats(pp, tr, key), share * i)), cut_lineage(_sized(_feats(pp, va, key), share))
        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            prepared = list(ex.map(window, range(1, folds + 1)))
    elif SP.cv_allowed(n, folds):
        fdf = cut_lineage(SP.stratified_folds(train, key, "label" if task == "classification" else None, folds, n_rows=n))

        def one(i):
            tr, va = fdf.where(F.col("fold") != i), fdf.where(F.col("fold") == i)
            pp = fit(tr, numeric, categorical)
            return (cut_lineage(_sized(_feats(pp, tr, key), n - n // folds)),
                    cut_lineage(_sized(_feats(pp, va, key), n // folds + 1)))
        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            prepared = list(ex.map(one, range(folds)))
    full = fit(train, numeric, categorical)
    return PreparedCV(key, numeric, categorical, prepared, full, cut_lineage(_sized(_feats(full, train, key), n)), n)


def train_candidate(name: str, task: str, cv: PreparedCV, n_classes: int, labels: list[str], goal: str = "",
                    seed: int = 42, parallelism: int = 4) -> Experiment:
    """M7: fit on every fold (fold-safe features from ``cv``) -> OOF predictions -> fold scores (A20) ->
    OOF-locked threshold (E11/E12, binary) -> refit on all training rows -> train metrics.  The k+1 fits
    of a candidate are independent Spark jobs submitted concurrently; test rows are never read here."""
    from concurrent.futures import ThreadPoolExecutor
    preset, family, params = resolve_model(name, task)
    exp = Experiment(name, preset, family, task, params, cv.numeric, cv.categorical, n_classes, labels)
    t0 = time.time()
    jobs = [(tr, va) for tr, va in cv.folds] + [(cv.full_feats, None)]

    def fit(job):
        tr, va = job
        m = fit_model(preset, task, tr, n_classes, seed)
        return m, (m.predict(va).drop("features") if va is not None else None)
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        fitted = list(ex.map(fit, jobs))
    if cv.folds:
        preds = [p for _, p in fitted[:-1]]
        oof = preds[0]
        for p in preds[1:]:
            oof = oof.unionByName(p)
        exp.oof = cut_lineage(oof)
        sc = _fold_score(task, exp.oof, n_classes)
        exp.cv_scores = sc
        s = M.cv_summary(sc.withColumn("model", F.lit(name)), ["model"], "score").first()
        exp.cv_mean, exp.cv_std = s["cv_mean"], s["cv_std"]
        if task == "classification" and n_classes == 2:
            from tabsight.operators.classify import goal_flags
            tt = M.threshold_table(exp.oof, "label", "p")
            exp.threshold = M.operating_threshold(tt, None, marketing=goal_flags(goal)["marketing"]).first()["threshold"]
    exp.preprocessor = cv.full
    exp.model = fitted[-1][0]
    exp.train_metrics = metrics_dict(task, predictions(exp.model, cv.full_feats), n_classes)
    exp.train_time_sec = time.time() - t0
    return exp


def predictions(model: FittedModel, feats: DataFrame) -> DataFrame:
    """Predictions, written once: metrics scan them several times, and a scan must not score every row again."""
    return cut_lineage(model.predict(feats))


def metrics_dict(task: str, pred: DataFrame, n_classes: int, cutoff: float | None = None) -> dict:
    """Headline metrics of one prediction frame as a small dict (one aggregation per family)."""
    out: dict = {}
    if task == "classification":
        if n_classes == 2:
            cut = 0.5 if cutoff is None else cutoff
            d = pred.withColumn("_pred", (F.col("p") >= cut).cast("int"))
            cm = M.classification_metrics(d.withColumn("_y", F.col("label").cast("int")), "_y", "_pred", None, "1").first()
            rk = M.ranking_metrics(pred, "label", "p").first()
            out.update(cm.asDict())
            out.update({k: rk[k] for k in ("roc_auc", "pr_auc", "brier_score", "log_loss", "prevalence")})
            out["is_binary"] = 1.0
            out["is_imbalanced"] = float(rk["is_imbalanced"])
        else:
            cm = M.classification_metrics(pred, "label", "prediction", None, positive=None).first()
            out.update({k: v for k, v in cm.asDict().items() if k != "n"})
            out.update(M.ovr_metrics(class_scores(pred, n_classes, []), "label", "class_id", "p").select("macro_roc_auc", "macro_pr_auc").first().asDict())
            true_p = F.greatest(F.get("probs", F.col("label").cast("int")), F.lit(1e-15))
            out["log_loss"] = pred.agg(F.avg(-F.log(true_p))).first()[0]
            out["is_binary"] = 0.0
    else:
        r = M.regression_metrics(pred, "label", "prediction", None, forecast=(task == "forecasting")).first()
        out.update(r.asDict())
    return {k: (float(v) if v is not None else None) for k, v in out.items()}


def evaluate_holdout(exp: Experiment, test: DataFrame, key: str) -> tuple[dict, dict | None, DataFrame]:
    """Champion scored once on the untouched test rows: metrics at the default cutoff and,
    for binary tasks with an OOF-locked threshold, at that cutoff (both kept, Q6)."""
    pred = predictions(exp.model, _feats(exp.preprocessor, test, key))
    default = metrics_dict(exp.task, pred, exp.n_classes)
    locked = None
    if exp.threshold is not None:
        locked = metrics_dict(exp.task, pred, exp.n_classes, cutoff=exp.threshold)
        locked["threshold"] = exp.threshold
    return default, locked, pred


def decode_labels(pred: DataFrame, labels: list[str], col: str = "prediction", out: str = "predicted_label") -> DataFrame:
    """Label index -> original label text."""
    from pyspark.ml.feature import IndexToString
    return IndexToString(inputCol=col, outputCol=out, labels=labels).transform(pred)


def save_model(exp: Experiment, path: str) -> None:
    """Persist the champion: fitted Spark ML stages and encoder (one folder each), and one row of JSON with all else that
    scoring needs (imputation and scaling values, constants, labels, threshold)."""
    import json
    pp = exp.preprocessor
    spark = exp.oof.sparkSession if exp.oof is not None else SparkSession.getActiveSession()
    for i, st in enumerate(exp.model.stages if exp.model else []):
        st.write().overwrite().save(f"{path}/stage_{i}")
    if pp is not None and pp.encoder is not None:
        pp.encoder.write().overwrite().save(f"{path}/encoder")
    meta = {k: getattr(exp, k) for k in ("name", "preset", "family", "task", "params", "numeric", "categorical", "n_classes", "labels", "threshold")}
    meta |= {"stages": [type(x).__module__ + "." + type(x).__name__ for x in exp.model.stages] if exp.model else [],
             "constants": exp.model.constants if exp.model else {},
             "encoder": type(pp.encoder).__module__ + "." + type(pp.encoder).__name__ if pp is not None and pp.encoder is not None else None,
             "preprocessor": {k: v for k, v in vars(pp).items() if k != "encoder"} if pp is not None else {}}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Experiment:
    """The champion that ``save_model`` wrote, ready to score."""
    import importlib
    import json

    def loaded(name: str, where: str):
        module, _, cls = name.rpartition(".")
        return getattr(importlib.import_module(module), cls).load(where)
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    kept = {k: meta[k] for k in ("name", "preset", "family", "task", "params", "numeric", "categorical", "n_classes", "labels", "threshold")}
    exp = Experiment(**kept)
    exp.preprocessor = (PP.OrdinalPreprocessor if exp.task == "forecasting" else PP.Preprocessor)(**meta["preprocessor"])
    if meta["encoder"]:
        exp.preprocessor.encoder = loaded(meta["encoder"], f"{path}/encoder")
    stages = [loaded(n, f"{path}/stage_{i}") for i, n in enumerate(meta["stages"])]
    exp.model = FittedModel(exp.preset, exp.task, exp.n_classes, stages, meta["constants"])
    return exp


def score(exp: Experiment, df: DataFrame, key: str) -> DataFrame:
    """Predictions of a fitted or loaded champion on rows with ``key`` and the raw feature columns."""
    own = df if "label" in df.columns else df.withColumn("label", F.lit(None).cast("double"))
    return exp.model.predict(_feats(exp.preprocessor, own, key))
