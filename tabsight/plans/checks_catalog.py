"""Registered SQL-box, source and catalog-join queries (SURVEY §2.1 S1-S12, S14; §2.2 P7-P11; §2.3 J1-J6;
§2.4 A1, A16-A18; §2.5 W5-W7; §2.6 K5; §2.8 F7, F12, F13; §2.12 E20)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.operators import evidence as EV
from tabsight.operators import sqlbox
from tabsight.plans import checks_metrics as CM
from tabsight.operators import metrics as M
from tabsight.session import checkpoint_dir, read_table, table_path
from tabsight.sources import readers as R

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

SQL_TOP10 = "SELECT c_mktsegment, COUNT(*) AS count FROM dataset GROUP BY c_mktsegment ORDER BY count DESC, c_mktsegment LIMIT 10"
SQL_AGG = ("SELECT AVG(o_totalprice) AS avg_value, MIN(o_totalprice) AS min_value, MAX(o_totalprice) AS max_value "
           "FROM data")
SQL_COUNT = "SELECT COUNT(*) AS total_rows FROM dataset"
SQL_RANK = ("-- revenue rank of each status within a priority\n"
            "WITH t AS (SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS revenue "
            "FROM dataset GROUP BY o_orderpriority, o_orderstatus) "
            "SELECT o_orderpriority, o_orderstatus, n, revenue, "
            "RANK() OVER (PARTITION BY o_orderpriority ORDER BY revenue DESC) AS revenue_rank FROM t")

SQL_NESTED = ("WITH big AS (WITH top AS (SELECT o_custkey, SUM(o_totalprice) AS spent FROM dataset GROUP BY o_custkey) "
              "SELECT o_custkey, spent, 'drop; -- x/*y*/' AS note FROM top WHERE spent > (SELECT AVG(spent) FROM top)), "
              "late AS (SELECT DISTINCT o_custkey FROM data WHERE o_orderstatus <> 'F') "
              "SELECT note, COUNT(*) AS n, MAX(spent) AS most FROM big WHERE o_custkey IN (SELECT o_custkey FROM late) GROUP BY note")


def _scratch(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint location (never a machine-local temp dir)."""
    return checkpoint_dir(spark).rstrip("/") + f"/scratch-{uuid.uuid4().hex}"


def sql_group_top10(spark, sf):
    return sqlbox.run_sql(spark, read_table(spark, sf, "customer"), SQL_TOP10)


def sql_avg_min_max(spark, sf):
    return sqlbox.run_sql(spark, read_table(spark, sf, "orders"), SQL_AGG)


def sql_total_rows(spark, sf):
    return sqlbox.run_sql(spark, read_table(spark, sf, "lineitem"), SQL_COUNT)


def sql_nested_cte(spark, sf):
    return sqlbox.run_sql(spark, read_table(spark, sf, "orders"), SQL_NESTED)


def sql_window_rank(spark, sf):
    return sqlbox.run_sql(spark, read_table(spark, sf, "orders"), SQL_RANK)


def table_inventory(spark, sf):
    out = None
    for t in TABLES:
        df = R.load_dataset(spark, table_path(sf, t))
        m = R.dataset_metadata(df, t, R.format_of(table_path(sf, t)))
        out = m if out is None else out.unionByName(m)
    return out


def csv_roundtrip(spark, sf):
    """orders -> ';'-separated CSV in the shared scratch area -> delimiter inference -> typed reload."""
    path = _scratch(spark) + "/orders_csv"
    R.write_csv(read_table(spark, sf, "orders"), path, ";")
    delim = R.detect_delimiters(spark, path).agg(F.min("delimiter").alias("d"), F.max("delimiter").alias("d2")).first()
    back = R.load_dataset(spark, path, delimiter=None, fmt="csv")
    return back.agg(F.count(F.lit(1)).alias("row_count"), F.sum("o_totalprice").alias("totalprice_sum"),
                    F.countDistinct("o_orderkey").alias("distinct_keys")).select(
        F.lit(delim["d"]).alias("delimiter"), F.lit(len(back.columns)).cast("long").alias("col_count"),
        "row_count", "totalprice_sum", "distinct_keys")


def json_roundtrip(spark, sf):
    path = _scratch(spark) + "/customer_json"
    read_table(spark, sf, "customer").write.mode("overwrite").json(path)
    back = R.load_dataset(spark, path)
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("acctbal_sum"))


def delimiter_sniff(spark, sf):
    """orders in one folder, odd keys separated by '|' and even ones by tabs -> one dataset and the delimiters of its files."""
    path, orders = _scratch(spark) + "/mixed_csv", read_table(spark, sf, "orders")
    for sep, part in (("|", orders.where("o_orderkey % 2 = 1")), ("\t", orders.where("o_orderkey % 2 = 0"))):
        part.write.mode("append").option("header", True).option("sep", sep).csv(path)
    kinds = R.detect_delimiters(spark, path).agg(F.array_join(F.array_sort(F.collect_set(F.ascii("delimiter"))).cast("array<string>"), ",").alias("codes"))
    back = R.load_dataset(spark, path, fmt="csv")
    return back.agg(F.count(F.lit(1)).alias("row_count"), F.sum("o_totalprice").alias("totalprice_sum"), F.countDistinct("o_orderkey").alias("distinct_keys"),
                    F.max(F.col("o_orderdate").cast("string")).alias("last_date")).select(
        F.lit(kinds.first()["codes"]).alias("delimiter_codes"), F.lit(len(back.columns)).cast("long").alias("col_count"), "row_count", "totalprice_sum", "distinct_keys",
        F.substring("last_date", 1, 10).alias("last_date"))


def file_checksums(spark, sf):
    """customer names written as one text file per nation -> the manifest of these files."""
    path, customer = _scratch(spark) + "/names", read_table(spark, sf, "customer")
    lines = customer.select("c_nationkey", "c_custkey", F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    lines.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey").write.partitionBy("c_nationkey").text(path)
    return R.file_manifest(spark, path).select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("c_nationkey"), "size_bytes", "checksum")


def latest_order_per_customer(spark, sf):
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return EV.latest_per_key(o, "o_custkey", ["o_orderdate", "o_orderkey"], "customer_key").select(
        "customer_key", "o_orderkey", "o_orderdate", "o_totalprice")


def orders_page(spark, sf):
    o = read_table(spark, sf, "orders")
    return EV.paginate(o, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], offset=20, limit=10) \
        .select("o_orderkey", "o_orderdate", "o_totalprice")


def unlabeled_documents(spark, sf):
    return EV.unseen_rows(read_table(spark, sf, "documents").select("doc_id", "lang"),
                          read_table(spark, sf, "labels"), "doc_id")


def returned_orders(spark, sf):
    o = read_table(spark, sf, "orders")
    r = read_table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return EV.rows_with_match(o, r, "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def dashboard_by_nation(spark, sf):
    latest = latest_order_per_customer(spark, sf)
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    j = latest.join(c, latest.customer_key == c.c_custkey, "inner").join(n, c.c_nationkey == n.n_nationkey, "left")
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), F.avg("o_totalprice").alias("avg_latest_price"))


def _flat_ranking(spark, sf):
    rm = M.ranking_metrics(CM.scored_lineitem(spark, sf), "y", "p", ["model"])
    return EV.flatten_metrics(rm, ["model"], ["roc_auc", "pr_auc", "brier_score", "log_loss", "prevalence"], "test")


def metric_rows(spark, sf):
    return _flat_ranking(spark, sf)


def model_comparison(spark, sf):
    f = _flat_ranking(spark, sf)
    return EV.compare_runs(f.where(F.col("model") == "qty_score"), f.where(F.col("model") == "disc_score"))


def registry_score(spark, sf):
    return EV.registry_scores(_flat_ranking(spark, sf), ["model"], F.lit("classification"))


def url_cleaning(spark, sf):
    p = read_table(spark, sf, "pages")
    kept = p.where(~EV.any_contains(F.split("url", "/"), "#"))
    return kept.select("page_id", EV.clean_filename(F.col("url")).alias("file_name"),
                       F.col("url").contains("?").alias("has_query"))


def json_props(spark, sf):
    e = read_table(spark, sf, "events")
    k = EV.json_field(F.col("props"), "$.k", "$.key", default="none")
    return e.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value_sum"))


QUERIES = {
    "sql_group_top10": sql_group_top10,
    "sql_avg_min_max": sql_avg_min_max,
    "sql_total_rows": sql_total_rows,
    "sql_window_rank": sql_window_rank,
    "sql_nested_cte": sql_nested_cte,
    "delimiter_sniff": delimiter_sniff,
    "file_checksums": file_checksums,
    "table_inventory": table_inventory,
    "csv_roundtrip": csv_roundtrip,
    "json_roundtrip": json_roundtrip,
    "latest_order_per_customer": latest_order_per_customer,
    "orders_page": orders_page,
    "unlabeled_documents": unlabeled_documents,
    "returned_orders": returned_orders,
    "dashboard_by_nation": dashboard_by_nation,
    "metric_rows": metric_rows,
    "model_comparison": model_comparison,
    "registry_score": registry_score,
    "url_cleaning": url_cleaning,
    "json_props": json_props,
}


def _ranking_long() -> str:
    rk = CM._ranking_sql(CM.SCORED_LI_SQL)
    return f"""(SELECT model, 'test' AS split_type, metric_name, metric_value FROM (
  UNPIVOT ({rk}) ON roc_auc, pr_auc, brier_score, log_loss, prevalence INTO NAME metric_name VALUE metric_value)
  WHERE metric_value IS NOT NULL AND NOT isnan(metric_value))"""


def oracle() -> dict[str, str]:
    inv = " UNION ALL ".join(
        f"SELECT '{t}' AS name, 'parquet' AS file_type, CAST(count(*) AS BIGINT) AS row_count, "
        f"(SELECT CAST(count(*) AS BIGINT) FROM information_schema.columns WHERE table_name = '{t}') AS col_count FROM {t}"
        for t in TABLES)
    latest = """(SELECT o_custkey AS customer_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS o_orderdate, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice
  FROM orders GROUP BY o_custkey)"""
    long = _ranking_long()
    return {
        "sql_group_top10": SQL_TOP10.replace("dataset", "customer"),
        "sql_avg_min_max": SQL_AGG.replace("data", "orders"),
        "sql_total_rows": SQL_COUNT.replace("dataset", "lineitem"),
        "sql_window_rank": SQL_RANK.replace("FROM dataset", "FROM orders"),
        "sql_nested_cte": SQL_NESTED.replace("FROM dataset", "FROM orders").replace("FROM data ", "FROM orders "),
        "delimiter_sniff": """SELECT '9,124' AS delimiter_codes, CAST(6 AS BIGINT) AS col_count, count(*) AS row_count, sum(o_totalprice) AS totalprice_sum,
  count(DISTINCT o_orderkey) AS distinct_keys, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last_date FROM orders""",
        "file_checksums": """SELECT c_nationkey, CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes, sha256(body) AS checksum FROM (
  SELECT c_nationkey, string_agg(c_custkey || '|' || c_name || '|' || c_mktsegment || chr(10), '' ORDER BY c_custkey) AS body FROM customer GROUP BY c_nationkey)""",
        "table_inventory": inv,
        "csv_roundtrip": """SELECT ';' AS delimiter, CAST(6 AS BIGINT) AS col_count, CAST(count(*) AS BIGINT) AS row_count,
  sum(o_totalprice) AS totalprice_sum, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS distinct_keys FROM orders""",
        "json_roundtrip": "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, sum(c_acctbal) AS acctbal_sum FROM customer GROUP BY 1",
        "latest_order_per_customer": f"SELECT * FROM {latest}",
        "orders_page": """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
  ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 20""",
        "unlabeled_documents": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "returned_orders": """SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders
  WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""",
        "dashboard_by_nation": f"""SELECT n.n_name, CAST(count(*) AS BIGINT) AS customers, avg(l.o_totalprice) AS avg_latest_price
  FROM {latest} l JOIN customer c ON l.customer_key = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  GROUP BY n.n_name""",
        "metric_rows": f"SELECT * FROM {long}",
        "model_comparison": f"""SELECT coalesce(a.metric_name, b.metric_name) AS metric_name, a.metric_value AS value_a,
  b.metric_value AS value_b, b.metric_value - a.metric_value AS difference
  FROM (SELECT * FROM {long} WHERE model = 'qty_score') a FULL JOIN (SELECT * FROM {long} WHERE model = 'disc_score') b
  ON a.metric_name = b.metric_name""",
        "registry_score": f"""SELECT model, CASE WHEN roc >= 0 AND roc <= 1 THEN 'Holdout ROC-AUC'
    WHEN pr >= 0 AND pr <= 1 THEN 'Holdout PR-AUC' ELSE 'Holdout Score' END AS score_name,
  round(CASE WHEN roc >= 0 AND roc <= 1 THEN roc WHEN pr >= 0 AND pr <= 1 THEN pr ELSE 0.5 END, 4) AS score
  FROM (SELECT model, max(CASE WHEN metric_name = 'roc_auc' THEN metric_value END) AS roc,
    max(CASE WHEN metric_name = 'pr_auc' THEN metric_value END) AS pr FROM {long} GROUP BY model)""",
        "url_cleaning": r"""SELECT page_id, regexp_replace(string_split(url, '/')[-1], '[^a-zA-Z0-9_.\-]', '_', 'g') AS file_name,
  contains(url, '?') AS has_query FROM pages WHERE NOT list_bool_or(list_transform(string_split(url, '/'), lambda x: contains(x, '#')))""",
        "json_props": """SELECT coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.key'), 'none') AS k,
  CAST(count(*) AS BIGINT) AS n, sum(value) AS value_sum FROM events GROUP BY 1""",
    }
