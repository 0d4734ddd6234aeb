"""Catalog-side relational operators and evidence / chart-data tables.

(W5-W7 latest per key, K5 pagination, K6/G1 leaderboard, J1-J6 joins, S12/S14 metric
flattening, E20 registry score, F7/F12/F13/F16/F17 string & JSON helpers, P7-P9
filters, G2-G13 evidence tables.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabsight.functions import exprs as X
from tabsight.operators import metrics as M


def latest_per_key(df: DataFrame, key: Column | str, order_cols: list[str], name: str = "key") -> DataFrame:
    """Newest row per key (largest ``order_cols`` tuple) as one aggregation.

    ``max_by`` combines map-side, so a key holding a third of the rows is still split
    over all tasks (a row_number window would send that key to one task)."""
    k = F.col(key) if isinstance(key, str) else key
    rest = [c for c in df.columns]
    agg = df.groupBy(k.alias(name)).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order_cols])).alias("_r"))
    return agg.select(name, "_r.*")


def paginate(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """K5: newest-first page (order must end with a unique key for stable pages)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def flatten_metrics(df: DataFrame, id_cols: list[str], metric_cols: list[str], split: str) -> DataFrame:
    """Every numeric, non-NaN metric becomes a row (id..., split_type, metric_name, metric_value)."""
    longf = df.unpivot(id_cols, [F.col(c).cast("double").alias(c) for c in metric_cols], "metric_name", "metric_value")
    return longf.where(F.col("metric_value").isNotNull() & ~F.isnan("metric_value")) \
                .withColumn("split_type", F.lit(split)).select(*id_cols, "split_type", "metric_name", "metric_value")


def metrics_map(long_metrics: DataFrame, id_cols: list[str]) -> DataFrame:
    """(id..., metrics map<string,double>) from the long metric rows."""
    return long_metrics.groupBy(*id_cols).agg(F.map_from_entries(F.collect_list(
        F.struct("metric_name", "metric_value"))).alias("metrics"))


def registry_scores(long_metrics: DataFrame, id_cols: list[str], task: Column) -> DataFrame:
    """E20 over flattened holdout metrics: (id..., score_name, score)."""
    mm = metrics_map(long_metrics, id_cols)
    name, score = M.registry_score(task, F.col("metrics"))
    return mm.select(*id_cols, name.alias("score_name"), score.alias("score"))


# Family labels of the leaderboard (fixed presentation values).
FAMILY_LABELS = {
    "baseline": "Baseline", "linear": "Linear model", "random_forest": "Random forest (bagging)",
    "gradient_boosting": "Gradient boosting", "seasonal_naive": "Seasonal naive",
}


def leaderboard(experiments: DataFrame, task_col: str = "task_type", score_col: str = "cv_mean",
                group_cols: list[str] | None = None) -> DataFrame:
    """K6/G1/M9: rank by CV score -- higher is better for classification, lower otherwise
    (missing scores rank last); rank 1 is the champion, chosen by CV only."""
    g = list(group_cols or [])
    cls = F.col(task_col) == "classification"
    s = F.col(score_col)
    key = F.when(cls, -F.coalesce(s, F.lit(0.0))).otherwise(F.coalesce(s, F.lit(999999.0)))
    w = Window.partitionBy(*g).orderBy(key, F.col("model_name"))  # one partition per run: candidates only
    fam = F.create_map(*[x for k, v in FAMILY_LABELS.items() for x in (F.lit(k), F.lit(v))])
    out = experiments.withColumn("rank", F.row_number().over(w))
    return out.withColumn("is_champion", F.col("rank") == 1).withColumn(
        "family_label", F.coalesce(fam[F.col("model_family")], F.col("model_family")))


def compare_runs(a: DataFrame, b: DataFrame, key: str = "metric_name", value: str = "metric_value") -> DataFrame:
    """Side-by-side metrics of two runs (full outer on the metric name) with the difference."""
    return a.select(key, F.col(value).alias("value_a")).join(b.select(key, F.col(value).alias("value_b")), key, "full") \
            .withColumn("difference", F.col("value_b") - F.col("value_a"))


def unseen_rows(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing`` (anti join)."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def rows_with_match(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Semi join."""
    return df.join(other.select(key), key, "left_semi")


def delete_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The table without the given ids (columnar files have no in-place delete)."""
    return table.join(ids.select(key), key, "left_anti")


# ---------------------------------------------------------------------------
# Text helpers over whole text columns
# ---------------------------------------------------------------------------

def clean_filename(c: Column) -> Column:
    """unsafe characters become '_' (after dropping any folder part)."""
    return X.clean_filename(F.element_at(F.split(c, "/"), -1))


def clean_dataset_label(c: Column) -> Column:
    """display label: drop leading run/upload prefixes and the extension, underscores to spaces."""
    base = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    base = F.regexp_replace(base, r"^(?:[0-9a-f]{8,}_|upload_|raw_)+", "")
    return F.trim(F.regexp_replace(base, "_+", " "))


def numbered_items(text: Column) -> Column:
    """F16: the items of numbered lists ('1. ...', '2) ...') anywhere in the text, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^\s*\d+[.)]\s+(.+?)\s*$"), F.lit(1))


def markdown_table_rows(df: DataFrame, text_col: str, id_cols: list[str]) -> DataFrame:
    """cells of markdown tables: (id..., line_no, cells array) for '|'-rows that are not separators."""
    lines = df.select(*id_cols, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    rows = lines.where(F.trim("line").startswith("|") & ~F.trim("line").rlike(r"^\|[\s:|-]+\|?$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return rows.select(*id_cols, "line_no", cells.alias("cells"))


def json_field(c: Column, *paths: str, default=None) -> Column:
    """first present JSON path, else the default."""
    vals = [F.get_json_object(c, p) for p in paths]
    if default is not None:
        vals.append(F.lit(default))
    return F.coalesce(*vals)


def any_contains(arr: Column, needle: str) -> Column:
    """Some array element contains the text."""
    return F.exists(arr, lambda x: x.contains(needle))


# ---------------------------------------------------------------------------
# Evidence tables (data behind reports and charts)
# ---------------------------------------------------------------------------

def threshold_excerpt(table: DataFrame, selected: float, k: int, group_cols: list[str] | None = None) -> DataFrame:
    """Cutoffs at multiples of 0.10 plus the selected one, the first ``k`` rows by cutoff (a chosen length of the excerpt)."""
    g = list(group_cols or [])
    keep = ((F.round(F.col("threshold") * 100) % 10) == 0) | (F.abs(F.col("threshold") - selected) < 1e-9)
    w = Window.partitionBy(*g).orderBy("threshold")
    return table.where(keep).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def default_vs_locked(table: DataFrame, locked: float, prevalence: Column | float | None = None) -> DataFrame:
    """Recall shift (points), tp gain, fn reduction and precision lift over prevalence."""
    d = table.where(F.abs(F.col("threshold") - 0.5) < 1e-3).select(
        *[F.col(c).alias(f"d_{c}") for c in ("recall", "tp", "fn", "precision")])
    lk = table.where(F.abs(F.col("threshold") - locked) < 1e-9).select(
        *[F.col(c).alias(f"l_{c}") for c in ("recall", "tp", "fn", "precision")])
    j = d.withColumn("_k", F.lit(1)).join(lk.withColumn("_k", F.lit(1)), "_k").drop("_k")
    out = j.select(((F.col("l_recall") - F.col("d_recall")) * 100).alias("recall_shift_points"),
                   (F.col("l_tp") - F.col("d_tp")).alias("tp_gain"), (F.col("d_fn") - F.col("l_fn")).alias("fn_reduction"),
                   "l_precision", "d_precision")
    if prevalence is not None:
        pv = prevalence if isinstance(prevalence, Column) else F.lit(float(prevalence))
        out = out.withColumn("precision_lift", F.when(pv > 0, F.col("l_precision") / pv))
    return out


def residual_histogram(df: DataFrame, y: str, pred: str, bins: int = 25) -> DataFrame:
    """Residual counts in ``bins`` equal-width bins between the min and max residual."""
    r = (F.col(y) - F.col(pred)).cast("double")
    b = df.select(r.alias("r"))
    mm = b.agg(F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return b.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    bucket = F.least(F.floor((F.col("r") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return b.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("count")).select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "count")


def hash_sample(df: DataFrame, key: str, n: int = 500) -> DataFrame:
    """Reproducible sample of n rows: smallest md5 order keys (a top-k, not a sort)."""
    return df.withColumn("_h", X.hash_rank_key(F.col(key))).orderBy("_h", key).limit(n).drop("_h")


#: Steps of a forecast that its trajectory shows.
TRAJECTORY_STEPS = 120


def forecast_trajectory(df: DataFrame, time: str, y: str, pred: str, steps: int = TRAJECTORY_STEPS) -> DataFrame:
    """The first ``steps`` rows in time order as (step, time, actual, predicted): a top-k, then a window over these rows.

    Rows without a time are left out; equal times are ordered by their values."""
    order = [time, "actual", "predicted"]
    first = df.where(F.col(time).isNotNull()).select(time, F.col(y).alias("actual"), F.col(pred).alias("predicted")).orderBy(*order).limit(steps)
    return first.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("step"), *order)


def insight_rows(facts: DataFrame) -> DataFrame:
    """Four-pillar insight rows from computed numbers; every pillar has a row (defaults fill gaps).

    ``facts`` columns: pillar, text.  Missing pillars get a default sentence."""
    pillars = facts.sparkSession.createDataFrame(
        [("observed", "No observed pattern passed the evidence checks."),
         ("model_derived", "No model-derived driver passed the evidence checks."),
         ("recommendation", "Collect more labelled data before acting on the model."),
         ("limitation", "Results describe association, not causation, within the analysed period.")],
        "pillar string, default_text string")
    got = facts.groupBy("pillar").agg(F.collect_list("text").alias("texts"))
    return pillars.join(got, "pillar", "left").select(
        "pillar", F.when(F.col("texts").isNull() | (F.size("texts") == 0), F.array("default_text"))
        .otherwise(F.col("texts")).alias("texts"))
