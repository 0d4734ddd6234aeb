"""Registered profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabsight.operators import stats
from tabsight.plans.sqlgen import SCHEMAS, categorical_profile_sql, numeric_profile_sql, q, semantic_type_sql
from tabsight.session import read_table

PROFILED_TABLES = ["customer", "orders", "lineitem", "part", "supplier", "documents", "events", "labels"]


def _dated_orders(spark: SparkSession, sf: str) -> DataFrame:
    """orders plus two date-string columns (ISO text and US text) derived from o_orderdate."""
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderstatus", "o_orderdate",
                    F.col("o_orderdate").cast("string").alias("order_day_text"),
                    F.date_format("o_orderdate", "MM/dd/yyyy").alias("order_day_us"))


DATED_ORDERS_SQL = ("(SELECT o_orderkey, o_orderstatus, o_orderdate, CAST(o_orderdate AS VARCHAR) AS order_day_text, "
                    "strftime(o_orderdate, '%m/%d/%Y') AS order_day_us FROM orders)")


def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return stats.numeric_profile(read_table(spark, sf, "lineitem"))


def profile_numeric_customer(spark: SparkSession, sf: str) -> DataFrame:
    return stats.numeric_profile(read_table(spark, sf, "customer"))


def profile_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return stats.categorical_profile(read_table(spark, sf, "customer"))


def profile_categorical_part(spark: SparkSession, sf: str) -> DataFrame:
    return stats.categorical_profile(read_table(spark, sf, "part"))


def column_types(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t in PROFILED_TABLES:
        cs = stats.column_stats(read_table(spark, sf, t), quantiles=False)
        part = cs.select(F.lit(t).alias("table_name"), "column", "semantic_type", "n_distinct")
        out = part if out is None else out.unionByName(part)
    dated = stats.column_stats(_dated_orders(spark, sf), quantiles=False)
    return out.unionByName(dated.select(F.lit("orders_dated").alias("table_name"), "column", "semantic_type",
                                        "n_distinct"))


def profile_datetime(spark: SparkSession, sf: str) -> DataFrame:
    a = stats.datetime_profile(_dated_orders(spark, sf)).withColumn("table_name", F.lit("orders_dated"))
    b = stats.datetime_profile(read_table(spark, sf, "events")).withColumn("table_name", F.lit("events"))
    c = stats.datetime_profile(read_table(spark, sf, "lineitem")).withColumn("table_name", F.lit("lineitem"))
    return a.unionByName(b).unionByName(c)


def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    p = read_table(spark, sf, "part")
    a = stats.top_categories(o, 10, ["o_orderstatus", "o_orderpriority", "o_custkey"]).withColumn("table_name", F.lit("orders"))
    b = stats.top_categories(p, 10, ["p_brand", "p_type", "p_size"]).withColumn("table_name", F.lit("part"))
    return a.unionByName(b)


def missingness(spark: SparkSession, sf: str) -> DataFrame:
    return stats.missingness(read_table(spark, sf, "orders"))


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").drop("doc_id")
    li = read_table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    a = stats.duplicate_rows(docs).withColumn("dataset", F.lit("documents_content"))
    b = stats.duplicate_rows(li).withColumn("dataset", F.lit("lineitem_flags"))
    c = stats.duplicate_rows(read_table(spark, sf, "orders")).withColumn("dataset", F.lit("orders"))
    return a.unionByName(b).unionByName(c)


def _oracle_numeric(table: str) -> str:
    cols = [c for c, k in SCHEMAS[table] if k == "n"]
    return numeric_profile_sql(table, cols)


def _oracle_column_types() -> str:
    parts = []
    for t in PROFILED_TABLES:
        for c, k in SCHEMAS[t]:
            parts.append(f"SELECT {q(t)} AS table_name, {q(c)} AS \"column\", {semantic_type_sql(t, c, k)} AS semantic_type, "
                         f"(SELECT CAST(count(DISTINCT \"{c}\") AS BIGINT) FROM {t}) AS n_distinct")
    for c, k in [("o_orderkey", "n"), ("o_orderstatus", "s"), ("o_orderdate", "t"), ("order_day_text", "s"),
                 ("order_day_us", "s")]:
        parts.append(f"SELECT 'orders_dated' AS table_name, {q(c)} AS \"column\", "
                     f"{semantic_type_sql(DATED_ORDERS_SQL, c, k)} AS semantic_type, "
                     f"(SELECT CAST(count(DISTINCT \"{c}\") AS BIGINT) FROM {DATED_ORDERS_SQL}) AS n_distinct")
    return " UNION ALL ".join(parts)


def _iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def _oracle_datetime() -> str:
    from tabsight.plans.sqlgen import parse_sql
    rows = []
    for src, name, cols in [(DATED_ORDERS_SQL, "orders_dated", [("o_orderdate", "t"), ("order_day_text", "s"),
                                                                ("order_day_us", "s")]),
                            ("events", "events", [("ts", "t")]), ("lineitem", "lineitem", [("l_shipdate", "t")])]:
        for c, k in cols:
            v = f'"{c}"' if k == "t" else parse_sql(f'"{c}"')
            rows.append(f"SELECT {q(c)} AS \"column\", {_iso(f'min({v})')} AS min_date, {_iso(f'max({v})')} AS max_date, "
                        f"CAST(count(DISTINCT \"{c}\") AS BIGINT) AS unique_dates, "
                        f"CAST(count(*) - count(\"{c}\") AS BIGINT) AS missing_count, {q(name)} AS table_name FROM {src}")
    return " UNION ALL ".join(rows)


def _oracle_top_categories() -> str:
    rows = []
    for t, cols in [("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"]), ("part", ["p_brand", "p_type", "p_size"])]:
        for c in cols:
            rows.append(f"""SELECT * FROM (SELECT {q(c)} AS "column", CAST("{c}" AS VARCHAR) AS value,
  CAST(count(*) AS BIGINT) AS count,
  CAST(row_number() OVER (ORDER BY count(*) DESC, CAST("{c}" AS VARCHAR)) AS INTEGER) AS rank, {q(t)} AS table_name
  FROM {t} WHERE "{c}" IS NOT NULL GROUP BY "{c}") WHERE rank <= 10""")
    return " UNION ALL ".join(rows)


def _oracle_missingness() -> str:
    cols = [c for c, _ in SCHEMAS["orders"]]
    per = " UNION ALL ".join(
        f"SELECT {q(c)} AS \"column\", CAST(count(*) - count(\"{c}\") AS BIGINT) AS missing_count, "
        f"(count(*) - count(\"{c}\")) * 100.0 / count(*) AS missing_pct FROM orders" for c in cols)
    tot_missing = " + ".join(f"(count(*) - count(\"{c}\"))" for c in cols)
    total = (f"SELECT '__total__' AS \"column\", CAST({tot_missing} AS BIGINT) AS missing_count, "
             f"({tot_missing}) * 100.0 / (count(*) * {len(cols)}) AS missing_pct FROM orders")
    return per + " UNION ALL " + total


def _dup_sql(src: str, cols: list[str], name: str) -> str:
    cl = ", ".join(f'"{c}"' for c in cols)
    return (f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, CAST(sum(n) AS BIGINT) AS n_rows, "
            f"coalesce(sum(n - 1), 0) * 100.0 / sum(n) AS duplicate_pct, {q(name)} AS dataset "
            f"FROM (SELECT count(*) AS n FROM {src} GROUP BY {cl}) g")


def _oracle_duplicates() -> str:
    return " UNION ALL ".join([
        _dup_sql("documents", ["text", "lang", "source", "n_chars"], "documents_content"),
        _dup_sql("lineitem", ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"], "lineitem_flags"),
        _dup_sql("orders", [c for c, _ in SCHEMAS["orders"]], "orders"),
    ])


def dataset_overview(spark: SparkSession, sf: str) -> DataFrame:
    from tabsight.plans.profile import dataset_overview as ov
    o = read_table(spark, sf, "orders")
    return ov(o, stats.column_stats(o, quantiles=False))


def dataset_preview(spark: SparkSession, sf: str) -> DataFrame:
    from tabsight.sources.readers import preview
    return preview(read_table(spark, sf, "nation"), 50, order_by=["n_nationkey"])


def correlation_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    from tabsight.plans.profile import full_profile
    return full_profile(read_table(spark, sf, "lineitem")).heatmap


QUERIES = {
    "dataset_overview": dataset_overview,
    "dataset_preview": dataset_preview,
    "correlation_heatmap": correlation_heatmap,
    "profile_numeric": profile_numeric,
    "profile_numeric_customer": profile_numeric_customer,
    "profile_categorical": profile_categorical,
    "profile_categorical_part": profile_categorical_part,
    "column_types": column_types,
    "profile_datetime": profile_datetime,
    "top_categories": top_categories,
    "missingness": missingness,
    "duplicate_rows": duplicate_rows,
}


def oracle() -> dict[str, str]:
    from tabsight.plans.checks_quality import _corr_pairs_sql
    ocols = [c for c, _ in SCHEMAS["orders"]]
    return {
        "dataset_overview": f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(ocols)} AS BIGINT) AS n_cols,
  CAST(0 AS BIGINT) AS missing_cells,
  (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT {', '.join(ocols)}, count(*) AS n FROM orders GROUP BY ALL)) AS duplicate_rows,
  (SELECT coalesce(sum(n - 1), 0) * 100.0 / sum(n) FROM (SELECT {', '.join(ocols)}, count(*) AS n FROM orders GROUP BY ALL)) AS duplicate_pct,
  0.0 AS missing_pct FROM orders""",
        "dataset_preview": """SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey
  FROM nation ORDER BY nation.n_nationkey LIMIT 50""",
        "correlation_heatmap": _corr_pairs_sql("lineitem", [c for c, k in SCHEMAS["lineitem"] if k == "n"]),
        "profile_numeric": _oracle_numeric("lineitem"),
        "profile_numeric_customer": numeric_profile_sql("customer", ["c_nationkey", "c_acctbal"]),
        "profile_categorical": categorical_profile_sql("customer", ["c_name", "c_mktsegment"]),
        "profile_categorical_part": categorical_profile_sql("part", ["p_name", "p_brand", "p_type"]),
        "column_types": _oracle_column_types(),
        "profile_datetime": _oracle_datetime(),
        "top_categories": _oracle_top_categories(),
        "missingness": _oracle_missingness(),
        "duplicate_rows": _oracle_duplicates(),
    }
