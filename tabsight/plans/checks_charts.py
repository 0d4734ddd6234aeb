"""Registered queries of permutation importance under a given model, forecast trajectories and dataset labels
(SURVEY §2 I4, G8, F7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.operators import evidence as EV
from tabsight.operators import explain as EX
from tabsight.operators import features as FE
from tabsight.operators import metrics as M
from tabsight.plans.checks_features import DAILY_SQL, daily_orders
from tabsight.session import read_table

FEATURES = ("net", "disc", "tax")


def _order_features(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("double")).alias("net"), F.avg(F.col("l_discount").cast("double")).alias("disc"),
        F.avg(F.col("l_tax").cast("double")).alias("tax"))
    orders = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("y"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).drop("l_orderkey")


def permutation_drops(spark: SparkSession, sf: str) -> DataFrame:
    """I4 under a given model: the price of an order from its net sum and its mean discount and tax."""
    rows = EX.permuted(_order_features(spark, sf), "o_orderkey", list(FEATURES))
    pred = rows.withColumn("pred", F.col("net") * (1 - F.col("disc")) * (1 + F.col("tax")))
    return M.regression_metrics(pred, "y", "pred", [EX.PERMUTED]).select(F.col(EX.PERMUTED).alias("feature"), "n", "mae", "rmse")


def forecast_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    """The first 120 steps of the seasonal naive forecast of daily orders."""
    series = FE.seasonal_naive(daily_orders(spark, sf), "day", "sales", None, 7).where(F.col("forecast").isNotNull())
    return EV.forecast_trajectory(series, "day", "sales", "forecast")


def dataset_labels(spark: SparkSession, sf: str) -> DataFrame:
    """display labels of file paths made of the customers' names and segments."""
    path = F.concat(F.lit("/data/upload_"), F.substring(F.md5("c_name"), 1, 8), F.lit("_"), "c_mktsegment", F.lit("__"), "c_name", F.lit(".csv"))
    return read_table(spark, sf, "customer").select("c_custkey", EV.clean_dataset_label(path).alias("label"))


QUERIES = {"permutation_drops": permutation_drops, "forecast_trajectory": forecast_trajectory, "dataset_labels": dataset_labels}


def _order_key(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _drops_sql() -> str:
    key = "CAST(o_orderkey AS VARCHAR)"
    moved = ", ".join(f"""p_{f} AS (SELECT {f}, row_number() OVER (ORDER BY {_order_key(f"{key} || '|perm{f}'")}, o_orderkey) AS i FROM d)""" for f in FEATURES)
    own = ["SELECT '' AS feature, y, net * (1 - disc) * (1 + tax) AS pred FROM b"]
    for f in FEATURES:
        net, disc, tax = (f"p.{x}" if x == f else f"b.{x}" for x in FEATURES)
        own.append(f"SELECT '{f}', y, {net} * (1 - {disc}) * (1 + {tax}) FROM b JOIN p_{f} p USING (i)")
    return f"""WITH d AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS y, net, disc, tax FROM orders JOIN (
    SELECT l_orderkey, sum(CAST(l_extendedprice AS DOUBLE)) AS net, avg(CAST(l_discount AS DOUBLE)) AS disc, avg(CAST(l_tax AS DOUBLE)) AS tax
    FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
  b AS (SELECT *, row_number() OVER (ORDER BY {_order_key(key)}, o_orderkey) AS i FROM d), {moved}
SELECT feature, CAST(count(*) AS BIGINT) AS n, avg(abs(y - pred)) AS mae, sqrt(avg((y - pred) * (y - pred))) AS rmse
FROM ({" UNION ALL ".join(own)}) GROUP BY feature"""


def oracle() -> dict[str, str]:
    path = "'/data/upload_' || substr(md5(c_name), 1, 8) || '_' || c_mktsegment || '__' || c_name || '.csv'"
    base = f"regexp_replace(list_extract(string_split({path}, '/'), -1), '\\.[A-Za-z0-9]+$', '')"
    return {
        "permutation_drops": _drops_sql(),
        "forecast_trajectory": f"""SELECT CAST(row_number() OVER (ORDER BY day) AS BIGINT) AS step, day, sales AS actual, forecast AS predicted FROM (
  SELECT day, sales, lag(sales, 7) OVER (ORDER BY day) AS forecast FROM {DAILY_SQL}) WHERE forecast IS NOT NULL ORDER BY day LIMIT {EV.TRAJECTORY_STEPS}""",
        "dataset_labels": f"""SELECT c_custkey, trim(regexp_replace(regexp_replace({base}, '^(?:[0-9a-f]{{8,}}_|upload_|raw_)+', ''), '_+', ' ', 'g')) AS label
FROM customer""",
    }
