"""Builders of the DuckDB reference SQL used by the correctness gate.

These produce plain SQL text over the pre-registered driver views; they are the
independent "other engine" side of each registered query, not part of any Spark
plan.  Column lists are the fixed driver schemas.
"""

from __future__ import annotations

# Fixed driver schemas (name, kind): kind n = numeric, s = string, t = timestamp.
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "n"), ("r_name", "s")],
    "nation": [("n_nationkey", "n"), ("n_name", "s"), ("n_regionkey", "n")],
    "customer": [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "n"), ("c_mktsegment", "s")],
    "supplier": [("s_suppkey", "n"), ("s_name", "s"), ("s_nationkey", "n"), ("s_acctbal", "n")],
    "part": [("p_partkey", "n"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "n"),
             ("p_retailprice", "n")],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "n"),
               ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "lineitem": [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"),
                 ("l_quantity", "n"), ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"),
                 ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")],
    "events": [("event_id", "n"), ("ts", "t"), ("user_id", "n"), ("event_type", "s"), ("value", "n"), ("props", "s")],
    "documents": [("doc_id", "n"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "n")],
    "labels": [("doc_id", "n"), ("quality", "n"), ("toxic", "n")],
    "conversations": [("conv_id", "n"), ("turn", "n"), ("role", "s"), ("text", "s")],
    "pages": [("page_id", "n"), ("url", "s"), ("html", "s")],
    "benchmark": [("item_id", "n"), ("text", "s")],
}

# Same fixed date-like patterns as the Spark side (RE2 syntax).
DATE_PATTERNS_SQL = [
    r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}",
    r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}",
    r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}",
    r"^(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}",
]
DATE_FORMATS_SQL = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d",
                    "%m/%d/%Y", "%b %d, %Y", "%d-%m-%Y"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def id_name(c: str) -> bool:
    lc = c.lower()
    return "id" in lc or "key" in lc or lc == "index"


def date_like_sql(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(trim({x}), {q(p)})" for p in DATE_PATTERNS_SQL) + ")"


def parse_sql(x: str) -> str:
    fmts = ", ".join(q(f) for f in DATE_FORMATS_SQL)
    return f"try_strptime(trim({x}), [{fmts}])"


def semantic_type_sql(src: str, col: str, kind: str) -> str:
    """SQL scalar subquery giving the semantic type of one column of ``src``."""
    x = f'"{col}"'
    nd = f"count(DISTINCT {x})"
    n = "count(*)"
    text_date = "FALSE"
    if kind == "s":
        text_date = (f"(count({x}) > 0 AND count_if({date_like_sql(x)})::DOUBLE / count({x}) >= 0.7 AND "
                     f"count(CASE WHEN {date_like_sql(x)} THEN {parse_sql(x)} END)::DOUBLE / count({x}) >= 0.8)")
    return (f"(SELECT CASE WHEN {nd} <= 1 THEN 'constant' "
            f"WHEN ({nd} = {n} OR {nd}::DOUBLE / {n} > 0.95) AND {'TRUE' if id_name(col) else 'FALSE'} THEN 'id' "
            f"WHEN {'TRUE' if kind == 't' else 'FALSE'} OR {text_date} THEN 'datetime' "
            f"WHEN {'TRUE' if kind == 'n' else 'FALSE'} THEN 'numeric' ELSE 'categorical' END FROM {src})")


def numeric_profile_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f'CAST("{c}" AS DOUBLE)'
        parts.append(f"""
SELECT {q(c)} AS "column", CAST(count({x}) AS BIGINT) AS count, avg({x}) AS mean,
  CASE WHEN count({x}) > 1 THEN stddev_samp({x}) ELSE 0.0 END AS std, min({x}) AS min,
  b.q25 AS q25, b.med AS median, b.q75 AS q75, max({x}) AS max,
  CASE WHEN count({x}) > 2 THEN coalesce(skewness({x}), 0.0) ELSE 0.0 END AS skewness,
  CASE WHEN count({x}) > 3 THEN coalesce(kurtosis({x}), 0.0) ELSE 0.0 END AS kurtosis,
  CAST(count_if({x} = 0) AS BIGINT) AS zero_count,
  CAST(count_if({x} < b.q25 - 1.5 * (b.q75 - b.q25) OR {x} > b.q75 + 1.5 * (b.q75 - b.q25)) AS BIGINT) AS outlier_count_x,
  CAST(count(*) AS BIGINT) AS n_rows_x,
  CAST(count(*) - count({x}) AS BIGINT) AS missing_count
FROM {src}, (SELECT quantile_cont({x}, 0.25) AS q25, quantile_cont({x}, 0.5) AS med,
                    quantile_cont({x}, 0.75) AS q75 FROM {src}) b
GROUP BY b.q25, b.med, b.q75""")
    inner = " UNION ALL ".join(parts)
    return f"""SELECT "column", count, mean, std, min, q25, median, q75, max, skewness, kurtosis, zero_count,
  CAST(outlier_count_x AS BIGINT) AS outlier_count, outlier_count_x * 100.0 / n_rows_x AS outlier_pct,
  missing_count, missing_count * 100.0 / n_rows_x AS missing_pct
FROM ({inner}) s"""


def categorical_profile_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f'"{c}"'
        parts.append(f"""
SELECT {q(c)} AS "column", CAST(count({x}) AS BIGINT) AS count, CAST(count(DISTINCT {x}) AS BIGINT) AS unique_count,
  count(DISTINCT {x}) / CAST(count(*) AS DOUBLE) AS cardinality_ratio,
  (SELECT CAST({x} AS VARCHAR) FROM {src} WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC, CAST({x} AS VARCHAR) LIMIT 1) AS top_value,
  CAST((SELECT count(*) FROM {src} WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC LIMIT 1) AS BIGINT) AS top_freq,
  (SELECT count(*) FROM {src} WHERE {x} IS NOT NULL GROUP BY {x} ORDER BY count(*) DESC LIMIT 1) * 100.0 / count(*) AS top_freq_pct,
  CAST(count(*) - count({x}) AS BIGINT) AS missing_count,
  (count(*) - count({x})) * 100.0 / count(*) AS missing_pct
FROM {src}""")
    return " UNION ALL ".join(parts)
