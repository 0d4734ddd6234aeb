"""Registered feature / split / preprocessing queries (SURVEY §2.5 W1-W4, §2.10 X1-X11, §2.11 M6,
§2.12 E18, F3, F14, J7, K1, P5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.functions import exprs as X
from tabsight.operators import features as FE
from tabsight.operators import metrics as M
from tabsight.operators import preprocess as PP
from tabsight.operators import split as SP
from tabsight.operators.ordered import exact_quantiles_from_counts
from tabsight.session import read_table

LAGS = FE.DEFAULT_LAGS
WINDOWS = FE.DEFAULT_WINDOWS


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Daily order totals: one series keyed by day."""
    o = read_table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("sales"), F.count(F.lit(1)).alias("n_orders"))


DAILY_SQL = "(SELECT o_orderdate AS day, sum(o_totalprice) AS sales, count(*) AS n_orders FROM orders GROUP BY o_orderdate)"


def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.sum("value").alias("value_sum"), F.count(F.lit(1)).alias("n_events"))


HOURLY_SQL = ("(SELECT event_type, date_trunc('hour', ts) AS hour, sum(value) AS value_sum, count(*) AS n_events "
              "FROM events GROUP BY event_type, date_trunc('hour', ts))")


def labeled_docs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").join(read_table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic")


LABELED_SQL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"

# ---------------------------------------------------------------------------
# Spark queries
# ---------------------------------------------------------------------------


def forecast_features_orders(spark, sf):
    return FE.lag_features(daily_orders(spark, sf), "day", "sales")


def forecast_features_events(spark, sf):
    return FE.lag_features(hourly_events(spark, sf), "hour", "value_sum", ["event_type"])


def chronological_split(spark, sf):
    f = FE.lag_features(daily_orders(spark, sf), "day", "sales")
    s = FE.chronological_split(f, "day", "day", 0.2)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"),
                                  F.max("day").alias("last_day"))


def walk_forward_folds(spark, sf):
    w = FE.walk_forward_folds(daily_orders(spark, sf), "day", 3)
    return w.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"),
                                         F.max("day").alias("last_day"))


def seasonal_naive_forecast(spark, sf):
    f = FE.seasonal_naive(daily_orders(spark, sf), "day", "sales", None, 7).where(F.col("forecast").isNotNull())
    return M.regression_metrics(f, "sales", "forecast", None, forecast=True)


def holdout_split_rows(spark, sf):
    return SP.holdout_split(labeled_docs(spark, sf), "doc_id", "toxic", 0.2).select("doc_id", "toxic", "split")


def split_sizes(spark, sf):
    ld = labeled_docs(spark, sf)
    parts = [
        SP.holdout_split(ld, "doc_id", "quality").groupBy(F.lit("labels.quality").alias("target"),
                                                          F.col("quality").cast("string").alias("class"), "split"),
        SP.holdout_split(read_table(spark, sf, "customer"), "c_custkey", "c_mktsegment").groupBy(
            F.lit("customer.c_mktsegment").alias("target"), F.col("c_mktsegment").alias("class"), "split"),
        SP.holdout_split(read_table(spark, sf, "part"), "p_partkey", None).groupBy(
            F.lit("part.none").alias("target"), F.lit("all").alias("class"), "split"),
    ]
    out = None
    for p in parts:
        a = p.agg(F.count(F.lit(1)).alias("n"))
        out = a if out is None else out.unionByName(a)
    return out


def fold_sizes(spark, sf):
    c = SP.stratified_folds(read_table(spark, sf, "customer"), "c_custkey", "c_mktsegment", 3)
    a = c.groupBy(F.lit("customer.c_mktsegment").alias("target"), F.col("c_mktsegment").alias("class"), "fold") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("acctbal_sum"))
    d = SP.stratified_folds(labeled_docs(spark, sf), "doc_id", "toxic", 3)
    b = d.groupBy(F.lit("labels.toxic").alias("target"), F.col("toxic").cast("string").alias("class"), "fold") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("double").alias("acctbal_sum"))
    return a.unionByName(b)


def impute_scale_params(spark, sf):
    cust = SP.holdout_split(read_table(spark, sf, "customer"), "c_custkey", "c_mktsegment")
    train = cust.where(F.col("split") == "train")
    num, cat = ["c_nationkey", "c_acctbal"], ["c_mktsegment", "c_name"]
    med = PP.fit_medians(train, num)
    sc = PP.fit_scaler(train, num)
    mo = PP.fit_modes(train, cat)
    n = med.join(sc, "column").select("column", "median", "mean", "scale", F.lit(None).cast("string").alias("mode"))
    c = mo.select("column", F.lit(None).cast("double").alias("median"), F.lit(None).cast("double").alias("mean"),
                  F.lit(None).cast("double").alias("scale"), "mode")
    return n.unionByName(c)


def onehot_vocabulary(spark, sf):
    p = SP.holdout_split(read_table(spark, sf, "part"), "p_partkey", None)
    return PP.vocabulary_usage(p.where(F.col("split") == "train"), p.where(F.col("split") == "test"), "p_type")


def ordinal_codes(spark, sf):
    """p_type codes fitted on the training part, applied to the test part (unseen -> next code)."""
    p = SP.holdout_split(read_table(spark, sf, "part"), "p_partkey", None)
    tr, te = p.where(F.col("split") == "train"), p.where(F.col("split") == "test")
    _, te_enc = PP.ordinal_encode(tr.select("p_partkey", "p_type"), te.select("p_partkey", "p_type"), ["p_type"])
    raw = te.select("p_partkey", F.col("p_type").alias("raw_type"))
    return te_enc.join(raw, "p_partkey").groupBy("raw_type", F.col("p_type").cast("int").alias("code")) \
        .agg(F.count(F.lit(1)).alias("n"))


def label_codes(spark, sf):
    enc, labels = PP.encode_labels(read_table(spark, sf, "customer"), "c_mktsegment", "code")
    return enc.groupBy(F.col("c_mktsegment").alias("label"), F.col("code").cast("int").alias("code")) \
              .agg(F.count(F.lit(1)).alias("n"))


def label_codes_missing(spark, sf):
    """Labels with gaps: the codes of what is left, and the alert that counts the rest."""
    c = read_table(spark, sf, "customer").withColumn("label", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    enc, _ = PP.encode_labels(c, "label", "code")
    codes = enc.groupBy("label", F.col("code").cast("int").alias("code")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return codes.unionByName(PP.missing_labels(c, "label").select(F.col("alert_type").alias("label"), F.lit(None).cast("int").alias("code"), F.col("metric").alias("n")))


def lags_blocked_events(spark, sf):
    """The plan for long series (blocks with a halo), forced, with one series whose key is NULL."""
    h = hourly_events(spark, sf).withColumn("event_type", F.expr("nullif(event_type, 'click')"))
    return FE.lag_features(h, "hour", "value_sum", ["event_type"], block_rows=64, max_series_rows=1)


def quantiles_bucketed(spark, sf):
    """Exact quartiles on the bucketed path with more buckets than tasks, with a NULL group."""
    li = read_table(spark, sf, "lineitem").select(F.expr("nullif(l_returnflag, 'N')").alias("flag"), "l_extendedprice")
    vc = li.groupBy("flag", "l_extendedprice").agg(F.count(F.lit(1)).alias("_cnt"))
    return exact_quantiles_from_counts(vc, ["flag"], "l_extendedprice", [0.25, 0.5, 0.75], n_buckets=200)


def chronological_split_text_key(spark, sf):
    """A cut inside a day: rows of the day are ordered by the hash of a text key."""
    o = read_table(spark, sf, "orders").select("o_orderdate", F.md5(F.col("o_orderkey").cast("string")).alias("k"))
    s = FE.chronological_split(o, "o_orderdate", "k", 0.2)
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_key"), F.max("o_orderdate").alias("last_day"),
                                  F.sum(X.hash_rank_key(F.col("k"))).alias("key_sum"))


def holdout_null_class(spark, sf):
    """Every document, unlabelled ones as a class of their own."""
    d = read_table(spark, sf, "documents").select("doc_id").join(read_table(spark, sf, "labels"), "doc_id", "left")
    return SP.holdout_split(d, "doc_id", "toxic", 0.2).select("doc_id", "toxic", "split")


def seasonal_naive_cv(spark, sf):
    """Fold scores of the fit-free candidate on the expanding windows of the training part."""
    f = FE.lag_features(daily_orders(spark, sf), "day", "sales")
    train = FE.chronological_split(f, "day", "day", 0.2).where("split = 'train'").withColumn("forecast", F.coalesce("target_lag_7", "target_lag_1"))
    va = FE.walk_forward_folds(train, "day", 3).where("role = 'validation'")
    return M.regression_metrics(va, "sales", "forecast", ["fold"], forecast=True).select("fold", "wape", "mae", "rmse")


QUERIES = {
    "lags_blocked_events": lags_blocked_events,
    "quantiles_bucketed": quantiles_bucketed,
    "chronological_split_text_key": chronological_split_text_key,
    "holdout_null_class": holdout_null_class,
    "seasonal_naive_cv": seasonal_naive_cv,
    "forecast_features_orders": forecast_features_orders,
    "forecast_features_events": forecast_features_events,
    "chronological_split": chronological_split,
    "walk_forward_folds": walk_forward_folds,
    "seasonal_naive_forecast": seasonal_naive_forecast,
    "holdout_split_rows": holdout_split_rows,
    "split_sizes": split_sizes,
    "fold_sizes": fold_sizes,
    "impute_scale_params": impute_scale_params,
    "onehot_vocabulary": onehot_vocabulary,
    "label_codes": label_codes,
    "label_codes_missing": label_codes_missing,
    "ordinal_codes": ordinal_codes,
}

# ---------------------------------------------------------------------------
# DuckDB oracle
# ---------------------------------------------------------------------------


def _feature_sql(src: str, time: str, target: str, part: str) -> str:
    pb = f"PARTITION BY {part} " if part else ""
    w = f"({pb}ORDER BY {time}"
    cols = [f"lag({target}, {k}) OVER {w}) AS target_lag_{k}" for k in LAGS]
    for n in WINDOWS:
        fr = f"{w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        cols.append(f"avg({target}) OVER {fr} AS target_roll_mean_{n}")
        cols.append(f"coalesce(stddev_samp({target}) OVER {fr}, 0.0) AS target_roll_std_{n}")
    cal = (f"CAST(isodow({time}) - 1 AS INTEGER) AS cal_dayofweek, CAST(day({time}) AS INTEGER) AS cal_day, "
           f"CAST(month({time}) AS INTEGER) AS cal_month, CAST(year({time}) AS INTEGER) AS cal_year, "
           f"CAST(isodow({time}) >= 6 AS INTEGER) AS cal_is_weekend")
    return f"SELECT * FROM (SELECT *, {cal}, {', '.join(cols)} FROM {src}) WHERE target_lag_{LAGS[0]} IS NOT NULL"


def _hash(col: str) -> str:
    return f"('0x' || substr(md5(CAST({col} AS VARCHAR)), 1, 8))::BIGINT"


def _split_sql(src: str, key: str, target: str | None, size: str = "0.2") -> str:
    part = f"PARTITION BY {target}" if target else ""
    quota = f"round(n * {size})" if target else f"ceil(n * {size})"
    return f"""(SELECT *, CASE WHEN pos < {quota} THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, row_number() OVER ({part} ORDER BY {_hash(key)}, {key}) - 1 AS pos, count(*) OVER ({part}) AS n FROM {src}))"""


def _folds_sql(src: str, key: str, target: str) -> str:
    return f"""(SELECT *, CAST((row_number() OVER (PARTITION BY {target} ORDER BY {_hash(key)}, {key}) - 1) % 3 AS INTEGER) AS fold
  FROM {src})"""


def oracle() -> dict[str, str]:
    feats = _feature_sql(DAILY_SQL, "day", "sales", "")
    seasonal = f"(SELECT day, sales, lag(sales, 7) OVER (ORDER BY day) AS forecast FROM {DAILY_SQL})"
    cust_split = _split_sql("customer", "c_custkey", "c_mktsegment")
    part_split = _split_sql("part", "p_partkey", None)
    null_type = f"(SELECT nullif(event_type, 'click') AS event_type, hour, value_sum, n_events FROM {HOURLY_SQL})"
    flags = "SELECT nullif(l_returnflag, 'N') AS flag, l_extendedprice AS v FROM lineitem"
    keyed = "(SELECT o_orderdate, md5(CAST(o_orderkey AS VARCHAR)) AS k FROM orders)"
    return {
        "lags_blocked_events": _feature_sql(null_type, "hour", "value_sum", "event_type"),
        "quantiles_bucketed": " UNION ALL ".join(
            f"SELECT flag, CAST({p} AS DOUBLE) AS p, quantile_cont(v, {p}) AS q FROM ({flags}) GROUP BY flag" for p in (0.25, 0.5, 0.75)),
        "chronological_split_text_key": f"""SELECT split, CAST(count(*) AS BIGINT) AS n, min(k) AS first_key, max(o_orderdate) AS last_day,
  CAST(sum({_hash('k')}) AS BIGINT) AS key_sum FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY o_orderdate, {_hash('k')}, k)
    <= CAST(floor((SELECT count(*) FROM orders) * 0.8) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM {keyed}) GROUP BY split""",
        "holdout_null_class": "SELECT doc_id, toxic, split FROM " + _split_sql(
            "(SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)", "doc_id", "toxic"),
        "seasonal_naive_cv": f"""WITH f AS ({feats}),
  t AS (SELECT day, sales, coalesce(target_lag_7, target_lag_1) AS p FROM f
        QUALIFY row_number() OVER (ORDER BY day) <= CAST(floor((SELECT count(*) FROM f) * 0.8) AS BIGINT)),
  b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY day) - 1) * 4 / (SELECT count(*) FROM t)::DOUBLE) AS INTEGER) AS fold FROM t)
SELECT fold, sum(abs(sales - p)) / sum(abs(sales)) * 100.0 AS wape, avg(abs(sales - p)) AS mae, sqrt(avg((sales - p) * (sales - p))) AS rmse
FROM b WHERE fold >= 1 GROUP BY fold""",
        "forecast_features_orders": feats,
        "forecast_features_events": _feature_sql(HOURLY_SQL, "hour", "value_sum", "event_type"),
        "chronological_split": f"""SELECT split, CAST(count(*) AS BIGINT) AS n, min(day) AS first_day, max(day) AS last_day FROM (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY day) <= CAST(floor((SELECT count(*) FROM ({feats})) * 0.8) AS BIGINT)
    THEN 'train' ELSE 'test' END AS split FROM ({feats})) GROUP BY split""",
        "walk_forward_folds": f"""WITH b AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY day) - 1) * 4 / (SELECT count(*) FROM {DAILY_SQL})::DOUBLE) AS INTEGER) AS blk
    FROM {DAILY_SQL}),
  f AS (SELECT b.*, fold FROM b, range(1, 4) r(fold) WHERE blk <= fold)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN blk = fold THEN 'validation' ELSE 'train' END AS role,
  CAST(count(*) AS BIGINT) AS n, min(day) AS first_day, max(day) AS last_day FROM f GROUP BY ALL""",
        "seasonal_naive_forecast": f"""SELECT CAST(count(*) AS BIGINT) AS n, avg(abs(sales - forecast)) AS mae,
  avg((sales - forecast) * (sales - forecast)) AS mse, sqrt(avg((sales - forecast) * (sales - forecast))) AS rmse,
  1 - sum((sales - forecast) * (sales - forecast)) / (var_pop(sales) * count(*)) AS r2,
  quantile_cont(abs(sales - forecast), 0.5) AS median_ae,
  avg(abs((sales - forecast) / CASE WHEN sales = 0 THEN 1e-6 ELSE sales END)) * 100.0 AS mape,
  max(abs(sales - forecast)) AS max_residual,
  quantile_cont(sales - forecast, 0.1) AS residual_p10, quantile_cont(sales - forecast, 0.25) AS residual_p25,
  quantile_cont(sales - forecast, 0.5) AS residual_p50, quantile_cont(sales - forecast, 0.75) AS residual_p75,
  quantile_cont(sales - forecast, 0.9) AS residual_p90,
  sum(abs(sales - forecast)) / sum(abs(sales)) * 100.0 AS wape,
  avg(CASE WHEN abs(sales) + abs(forecast) = 0 THEN 0.0 ELSE 2.0 * abs(sales - forecast) / (abs(sales) + abs(forecast)) END) * 100.0 AS smape
FROM {seasonal} WHERE forecast IS NOT NULL""",
        "holdout_split_rows": f"SELECT doc_id, toxic, split FROM {_split_sql(LABELED_SQL, 'doc_id', 'toxic')}",
        "split_sizes": f"""SELECT 'labels.quality' AS target, CAST(quality AS VARCHAR) AS class, split, CAST(count(*) AS BIGINT) AS n
  FROM {_split_sql(LABELED_SQL, 'doc_id', 'quality')} GROUP BY ALL
UNION ALL SELECT 'customer.c_mktsegment', c_mktsegment, split, count(*) FROM {cust_split} GROUP BY ALL
UNION ALL SELECT 'part.none', 'all', split, count(*) FROM {part_split} GROUP BY ALL""",
        "fold_sizes": f"""SELECT 'customer.c_mktsegment' AS target, c_mktsegment AS class, fold, CAST(count(*) AS BIGINT) AS n,
  sum(c_acctbal) AS acctbal_sum FROM {_folds_sql('customer', 'c_custkey', 'c_mktsegment')} GROUP BY ALL
UNION ALL SELECT 'labels.toxic', CAST(toxic AS VARCHAR), fold, count(*), CAST(sum(n_chars) AS DOUBLE)
  FROM {_folds_sql(LABELED_SQL, 'doc_id', 'toxic')} GROUP BY ALL""",
        "impute_scale_params": f"""WITH t AS (SELECT * FROM {cust_split} WHERE split = 'train')
SELECT 'c_nationkey' AS "column", quantile_cont(c_nationkey::DOUBLE, 0.5) AS median, avg(c_nationkey::DOUBLE) AS mean,
  CASE WHEN stddev_pop(c_nationkey::DOUBLE) = 0 THEN 1.0 ELSE stddev_pop(c_nationkey::DOUBLE) END AS scale, NULL::VARCHAR AS mode FROM t
UNION ALL SELECT 'c_acctbal', quantile_cont(c_acctbal, 0.5), avg(c_acctbal),
  CASE WHEN stddev_pop(c_acctbal) = 0 THEN 1.0 ELSE stddev_pop(c_acctbal) END, NULL FROM t
UNION ALL SELECT 'c_mktsegment', NULL, NULL, NULL, (SELECT c_mktsegment FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
UNION ALL SELECT 'c_name', NULL, NULL, NULL, (SELECT c_name FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""",
        "onehot_vocabulary": f"""WITH s AS {part_split},
  v AS (SELECT p_type AS category, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code, count(*) AS train_count
    FROM s WHERE split = 'train' GROUP BY p_type),
  t AS (SELECT p_type AS category, count(*) AS test_count FROM s WHERE split = 'test' GROUP BY p_type)
SELECT v.category, v.code, CAST(v.train_count AS BIGINT) AS train_count, CAST(coalesce(t.test_count, 0) AS BIGINT) AS test_count
  FROM v LEFT JOIN t ON v.category = t.category
UNION ALL SELECT '<unknown>', CAST((SELECT count(*) FROM v) AS INTEGER), CAST(0 AS BIGINT), CAST(sum(test_count) AS BIGINT)
  FROM t WHERE category NOT IN (SELECT category FROM v) HAVING count(*) > 0""",
        "ordinal_codes": f"""WITH s AS {part_split},
  v AS (SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS code FROM s WHERE split = 'train' GROUP BY p_type)
SELECT t.p_type AS raw_type, coalesce(v.code, CAST((SELECT count(*) FROM v) AS INTEGER)) AS code, CAST(count(*) AS BIGINT) AS n
FROM s t LEFT JOIN v ON t.p_type = v.p_type WHERE t.split = 'test' GROUP BY ALL""",
        "label_codes_missing": """SELECT c_mktsegment AS label, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code, CAST(count(*) AS DOUBLE) AS n
  FROM customer WHERE c_acctbal >= 0 GROUP BY c_mktsegment
  UNION ALL SELECT 'missing_target', NULL, 100.0 * count(*) FILTER (c_acctbal < 0) / count(*) FROM customer HAVING count(*) FILTER (c_acctbal < 0) > 0""",
        "label_codes": """SELECT c_mktsegment AS label, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code,
  CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_mktsegment""",
    }
