"""Registered queries over a run catalog that Spark fills from the given tables (SURVEY §2.1 S9, S11, S12, S15; §2.2 P7;
§2.3 J1, J2, J4, J5; §2.4 A19; §2.5 W6, W7; §2.6 K5).

Nations are datasets, orders are analysis runs, their lines are experiments and models.  The datasets of one region are deleted,
with all that hangs on them, and one of these is registered again under its old id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from tabsight.session import checkpoint_dir, read_table
from tabsight.sources.catalog import Catalog

GONE_REGION = 0


def _text(c: str):
    return F.col(c).cast("string")


def filled_catalog(spark: SparkSession, sf: str) -> Catalog:
    base = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    cat = Catalog(spark, base + "/catalog")
    nation, customer = read_table(spark, sf, "nation"), read_table(spark, sf, "customer")
    sizes = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("row_count"))
    manifest = nation.join(sizes, "n_nationkey", "left").select(
        _text("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("/data/"), "n_name").alias("file_path"), F.lit("parquet").alias("file_type"),
        (F.col("row_count") * 100).alias("size_bytes"), "row_count", F.lit(5).cast("long").alias("col_count"), F.md5("n_name").alias("checksum"), "n_regionkey")
    cat.register_datasets(manifest.drop("n_regionkey"))
    cat.register_datasets(manifest.drop("n_regionkey"))  # the same checksums again: nothing new

    orders = read_table(spark, sf, "orders").join(customer.select(F.col("c_custkey").alias("o_custkey"), _text("c_nationkey").alias("dataset_id")), "o_custkey")
    at = F.col("o_orderdate").cast("timestamp")
    runs = orders.select(
        _text("o_orderkey").alias("id"), "dataset_id", F.col("o_orderpriority").alias("user_goal"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED").alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), "regression").otherwise("classification").alias("problem_type"), F.lit("y").alias("target_column"),
        F.lit(None).cast("string").alias("time_column"), F.lit("kfold").alias("validation_strategy"), F.concat(_text("o_orderkey"), F.lit(":1:model")).alias("final_model_id"),
        F.lit("[]").alias("critic_findings_json"), at.alias("created_at"), at.alias("completed_at"))
    lines = read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.max(c).alias(c) for c in ("l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")])
    lines.write.parquet(base + "/lines")  # three tables are filled from it
    plain = spark.read.parquet(base + "/lines")
    named = (F.concat(_text("l_orderkey"), F.lit(":"), _text("l_linenumber")).alias("experiment_id"), _text("l_orderkey").alias("analysis_id"),
             F.concat(F.lit("m"), _text("l_linenumber")).alias("model_name"), F.col("l_shipdate").cast("timestamp").alias("created_at"))
    lines = plain.select("*", *named)
    with cat.commit() as c:
        c.append("analysis_runs", runs)
        c.append("experiments", plain.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "dataset_id"), "l_orderkey").select("*", *named).select(
            F.col("experiment_id").alias("id"), "analysis_id", "dataset_id", "model_name", F.col("l_returnflag").alias("model_family"), F.lit("kfold").alias("validation_strategy"),
            F.lit(3).alias("cv_folds"), F.lit(0.0).alias("train_time_sec"), F.col("l_discount").alias("cv_mean"), F.col("l_tax").alias("cv_std"),
            F.array(F.lit("x")).alias("feature_names"), F.lit("COMPLETED").alias("status"), "created_at"))
        c.append("models", lines.select(
            F.concat("experiment_id", F.lit(":model")).alias("id"), "experiment_id", "analysis_id", F.col("model_name").alias("name"),
            F.when(F.col("l_linestatus") == "F", "classification").otherwise("regression").alias("task_type"), (F.col("l_linenumber") == 1).alias("is_best"),
            F.lit(None).cast("string").alias("artifact_path"), F.lit("[]").alias("feature_importance_json"), "created_at"))
        measured = lines.select("experiment_id", "analysis_id", "created_at", F.explode(F.array(
            F.struct(F.lit("roc_auc").alias("metric_name"), (F.col("l_discount") * 10).alias("metric_value"), F.lit("test").alias("split_type")),
            F.struct(F.lit("threshold").alias("metric_name"), F.col("l_tax").alias("metric_value"), F.lit("test_locked").alias("split_type")))).alias("m"))
        c.append("experiment_metrics", measured.select(F.concat_ws(":", "experiment_id", "m.metric_name").alias("id"), "experiment_id", "analysis_id", "m.*", "created_at"))
        c.append("dataset_profiles", nation.where("n_nationkey % 2 = 0").select(
            F.concat(F.lit("p"), _text("n_nationkey")).alias("id"), _text("n_nationkey").alias("dataset_id"), F.lit("{}").alias("column_types"), F.lit("[]").alias("quality_alerts"),
            F.lit("[]").alias("candidate_targets"), F.when(F.col("n_nationkey") % 3 == 0, "regression").otherwise("eda").alias("inferred_problem_type"), F.current_timestamp().alias("created_at")))
    gone = manifest.where(F.col("n_regionkey") == GONE_REGION).select("id")
    cat.delete("datasets", gone)
    again = manifest.where(F.col("n_regionkey") == GONE_REGION).orderBy(F.col("id").cast("int")).limit(1)
    cat.register_datasets(again.drop("n_regionkey"))
    return cat


def catalog_dashboard(spark, sf):
    return filled_catalog(spark, sf).dashboard().select("label", "dataset_id", "model_name", "problem_type", "analysis_id")


def catalog_counts(spark, sf):
    cat = filled_catalog(spark, sf)
    cat.compact()
    return cat.counts()


def catalog_evidence(spark, sf):
    """The latest completed run of every dataset, beside the run with the smallest key."""
    found = filled_catalog(spark, sf)
    first = found.read("analysis_runs").agg(F.min_by("id", F.col("id").cast("long")).alias("id")).first()["id"]
    return found.evidence(comparison_id=first).select(
        "id", "dataset_id", "dataset_name", "problem_type", F.size("experiments").cast("long").alias("n_experiments"),
        F.col("champion_metrics")["test"]["roc_auc"].alias("roc_auc"), "locked_threshold", F.col("comparison.id").alias("compared_with"),
        F.col("comparison.problem_type").alias("compared_problem_type"))


def catalog_models(spark, sf):
    """The latest best model of each dataset for classification, a page of them."""
    return filled_catalog(spark, sf).models_page(is_best=True, task_type="classification", latest_per_dataset=True, offset=2, limit=10).select(
        "id", "name", "task_type", "dataset_id", "dataset_name")


def catalog_profiles(spark, sf):
    both = filled_catalog(spark, sf).datasets_with_profile()
    return both.select(F.col("d.id").alias("dataset_id"), F.col("d.name").alias("name"), F.col("d.row_count").alias("row_count"), F.col("p.inferred_problem_type").alias("inferred_problem_type"))


QUERIES = {f.__name__: f for f in (catalog_dashboard, catalog_counts, catalog_evidence, catalog_models, catalog_profiles)}


def oracle() -> dict[str, str]:
    head = f"""WITH gone AS (SELECT n_nationkey FROM nation WHERE n_regionkey = {GONE_REGION}),
  datasets AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, c.n AS row_count, n_nationkey FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
    WHERE n_nationkey NOT IN (FROM gone) OR n_nationkey = (SELECT min(n_nationkey) FROM gone)),
  runs AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS dataset_id, o_orderstatus, o_orderdate,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'regression' ELSE 'classification' END AS problem_type
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey NOT IN (FROM gone)),
  lines AS (SELECT l_orderkey, l_linenumber, max(l_discount) AS d, max(l_tax) AS t, max(l_linestatus) AS st, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2),
  of_runs AS (SELECT lines.*, runs.dataset_id FROM lines JOIN runs ON l_orderkey = o_orderkey),
  alive AS (SELECT lines.*, runs.dataset_id FROM lines LEFT JOIN runs ON l_orderkey = o_orderkey
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (FROM gone))),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY o_orderdate DESC, id DESC) AS rn FROM runs WHERE o_orderstatus = 'F') WHERE rn = 1)"""
    return {
        "catalog_dashboard": f"""{head}
SELECT coalesce(d.name, r.dataset_id) AS label, r.dataset_id, 'm1' AS model_name, r.problem_type, r.id AS analysis_id
FROM latest r JOIN lines ON l_orderkey = r.o_orderkey AND l_linenumber = 1 LEFT JOIN datasets d ON d.id = r.dataset_id""",
        "catalog_counts": f"""{head}
SELECT 'datasets' AS table_name, count(*) AS n FROM datasets UNION ALL SELECT 'analysis_runs', count(*) FROM runs
UNION ALL SELECT 'experiments', count(*) FROM of_runs UNION ALL SELECT 'models', count(*) FROM alive""",
        "catalog_evidence": f"""{head}, base AS (SELECT * FROM runs ORDER BY o_orderkey LIMIT 1)
SELECT r.id, r.dataset_id, d.name AS dataset_name, r.problem_type, coalesce(e.n, -1) AS n_experiments, c.d * 10 AS roc_auc, c.t AS locked_threshold,
  base.id AS compared_with, base.problem_type AS compared_problem_type
FROM latest r LEFT JOIN datasets d ON d.id = r.dataset_id LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lines GROUP BY 1) e ON e.l_orderkey = r.o_orderkey
LEFT JOIN lines c ON c.l_orderkey = r.o_orderkey AND c.l_linenumber = 1, base""",
        "catalog_models": f"""{head}
SELECT id, name, task_type, dataset_id, dataset_name FROM (
  SELECT l_orderkey || ':1:model' AS id, 'm1' AS name, 'classification' AS task_type, a.dataset_id, d.name AS dataset_name, shipped,
    row_number() OVER (PARTITION BY coalesce(a.dataset_id, d.name, 'm1') ORDER BY shipped DESC, l_orderkey || ':1:model' DESC) AS rn
  FROM alive a LEFT JOIN datasets d ON d.id = a.dataset_id WHERE l_linenumber = 1 AND st = 'F') WHERE rn = 1 ORDER BY shipped DESC, id DESC LIMIT 10 OFFSET 2""",
        "catalog_profiles": f"""{head}
SELECT id AS dataset_id, name, row_count, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey NOT IN (FROM gone) THEN CASE WHEN n_nationkey % 3 = 0 THEN 'regression' ELSE 'eda' END END AS inferred_problem_type FROM datasets""",
    }
