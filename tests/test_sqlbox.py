import pytest
from pyspark.sql import functions as F

from tabsight.operators import sqlbox

ALLOWED = """SELECT * FROM dataset
WITH t AS (SELECT 1 AS a) SELECT a FROM t
WITH t AS (WITH u AS (SELECT k FROM data) SELECT k FROM u), v AS (SELECT k + 1 AS k FROM t) SELECT t.k FROM t JOIN v ON t.k = v.k
WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 3) SELECT * FROM t
SELECT replace(s, 'a', 'b') FROM dataset
SELECT 'drop table' AS s FROM dataset
SELECT 'x/*y*/z' AS a, 'a--b' AS b FROM data
SELECT /*+ REPARTITION(2) */ k FROM dataset
SELECT explode(array(1, 2)) AS x FROM dataset
SELECT x FROM dataset LATERAL VIEW explode(array(k)) t AS x
SELECT k, sum(id) OVER (PARTITION BY k ORDER BY id) AS r FROM dataset WHERE id IN (SELECT k FROM data)
SELECT k, count(*) AS n FROM dataset GROUP BY GROUPING SETS ((k), ()) HAVING count(*) > 1 ORDER BY 1 LIMIT 3 OFFSET 1
SELECT k FROM dataset GROUP BY CUBE(k)
SELECT * FROM dataset d JOIN dataset e USING (id) LEFT JOIN (SELECT 1 AS x) z ON true
SELECT k FROM dataset UNION ALL SELECT id FROM dataset EXCEPT SELECT 1 INTERSECT SELECT 2
SELECT * FROM (SELECT k, id FROM dataset) PIVOT (sum(id) FOR k IN (0, 1))
SELECT * FROM (SELECT id, k FROM dataset) UNPIVOT (v FOR n IN (id, k))
SELECT d.id, y FROM dataset d, LATERAL (SELECT d.id + 1 AS y)
SELECT * FROM VALUES (1, 2), (3, 4) AS t(a, b)
SELECT * FROM range(3)
SELECT id, row_number() OVER w AS r FROM dataset WINDOW w AS (ORDER BY id)
SELECT transform(array(k), x -> x + 1) AS t FROM dataset
SELECT id FROM dataset WHERE EXISTS (SELECT 1 FROM data d2 WHERE d2.id = dataset.id)
FROM dataset |> WHERE id > 1 |> SELECT id
TABLE dataset
EXPLAIN SELECT * FROM dataset
DESCRIBE dataset
DESCRIBE QUERY SELECT * FROM dataset
SHOW COLUMNS IN dataset
-- comment
SELECT 1""".replace("-- comment\nSELECT 1", "-- comment\\nSELECT 1").split("\n")

REFUSED = """DROP TABLE dataset
DELETE FROM dataset
UPDATE dataset SET a = 1
ATTACH 'x.db' AS x
SELECT 1; SELECT 2
WITH t AS (SELECT * FROM other) SELECT * FROM t
SELECT * FROM dataset WHERE k IN (SELECT k FROM secret.tab)
SELECT * FROM dataset WHERE k = (WITH other AS (SELECT 1 AS k) SELECT max(k) FROM other) AND id IN (SELECT id FROM other)
WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a
SELECT (WITH other AS (SELECT 1 AS k) SELECT k FROM other) AS x, * FROM other
SELECT * FROM parquet.`/tmp/x`
SELECT * FROM default.dataset
SELECT reflect('java.lang.System', 'getProperty', 'user.home')
SELECT builtin.java_method('java.lang.System', 'getProperty', 'user.home')
SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')
SELECT IDENTIFIER('k') FROM dataset
SELECT * FROM IDENTIFIER('other')
EXECUTE IMMEDIATE 'SELECT * FROM other'
SELECT TRANSFORM(k) USING 'cat' AS (b) FROM dataset
FROM dataset MAP k USING 'cat' AS b
SELECT input_file_name() FROM dataset
SELECT own_function(1)
SELECT current_user()
SELECT * FROM read_files('/tmp')
SELECT * FROM java_method('a', 'b')
SELECT :x
EXPLAIN SELECT * FROM other
EXPLAIN DROP TABLE dataset
DESCRIBE other
SHOW TABLES
SHOW COLUMNS IN other
INSERT INTO dataset SELECT 1
CREATE TABLE t AS SELECT 1
CACHE TABLE dataset
SET spark.sql.ansi.enabled=false
ADD JAR '/tmp/x.jar'
REFRESH TABLE dataset
BEGIN SELECT 1; END
DECLARE x INT
SELECT * FROM dataset VERSION AS OF 1""".split("\n")


@pytest.fixture(scope="module")
def df(spark):
    spark.range(7).createOrReplaceTempView("other")
    spark.udf.register("own_function", lambda x: x)
    spark.range(1).createOrReplaceTempView("dataset")  # the caller's own view of this name
    yield spark.range(10).select("id", (F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("s"))
    for n in ("other", "dataset"):
        spark.catalog.dropTempView(n)


@pytest.mark.parametrize("q", ALLOWED)
def test_queries_over_the_dataset_run(spark, df, q):
    q = q.replace("\\n", "\n")
    assert sqlbox.validate_sql(q, spark=spark) == (True, "ok")
    sqlbox.run_sql(spark, df, q).collect()


@pytest.mark.parametrize("q", [*REFUSED, "", "  "])
def test_everything_else_is_refused(spark, df, q):
    assert not sqlbox.validate_sql(q, spark=spark)[0]
    with pytest.raises(ValueError):
        sqlbox.run_sql(spark, df, q)


def test_the_analysed_plan_is_judged_too(spark, df, monkeypatch):
    """With the parsed plan's check out of the way, the second fence still holds."""
    monkeypatch.setattr(sqlbox._Box, "parsed", lambda *a: iter(()))
    for q in ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT input_file_name() FROM dataset",
              "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.home')", "SELECT TRANSFORM(k) USING 'cat' AS (b) FROM dataset"):
        with pytest.raises(ValueError, match="Refused"):
            sqlbox.run_sql(spark, df, q)
    from pyspark.errors import AnalysisException
    for q in ("SELECT * FROM IDENTIFIER('other')", "SELECT * FROM other", "SELECT own_function(1)"):
        with pytest.raises((ValueError, AnalysisException)):
            sqlbox.run_sql(spark, df, q)


def test_a_persistent_table_is_not_the_dataset(spark, df, monkeypatch, tmp_path):
    spark.sql(f"CREATE TABLE kept_table USING parquet LOCATION '{tmp_path}/t' AS SELECT 1 AS secret")
    try:
        assert not sqlbox.validate_sql("SELECT * FROM kept_table", spark=spark)[0]
        monkeypatch.setattr(sqlbox._Box, "parsed", lambda *a: iter(()))
        with pytest.raises(ValueError, match="isn't part of the dataset"):
            sqlbox.run_sql(spark, df, "SELECT * FROM kept_table")
    finally:
        spark.sql("DROP TABLE kept_table")


def test_the_callers_session_is_left_alone(spark, df):
    assert sqlbox.run_sql(spark, df, "SELECT count(*) AS n FROM dataset").first()["n"] == 10
    assert spark.table("dataset").count() == 1 and not spark.catalog.tableExists("data")
    out = sqlbox.run_sql(spark, df, "SELECT * FROM dataset")
    assert out.sparkSession is spark and out.join(df, "id").count() == 10


def test_settings_of_the_session_hold(spark, df):
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        assert sqlbox.run_sql(spark, df, "SELECT CAST('x' AS INT) AS n").first()["n"] is None
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_literals_are_left_alone(spark):
    df = spark.createDataFrame([("xz",), ("x/*y*/z",), ("a--b",)], "s string")
    assert [r["s"] for r in sqlbox.run_sql(spark, df, "SELECT s FROM dataset WHERE s = 'x/*y*/z'").collect()] == ["x/*y*/z"]
    assert [r["s"] for r in sqlbox.run_sql(spark, df, "SELECT s FROM data WHERE s = 'a--b' -- end").collect()] == ["a--b"]
    res = sqlbox.run_sql_result(spark, df, "SELECT s FROM dataset", limit=2)
    assert res["truncated"] and res["row_count"] == 2


def test_group_by_runs_and_cap(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 AS k")
    res = sqlbox.run_sql_result(spark, df, "SELECT k, COUNT(*) AS n FROM dataset GROUP BY k ORDER BY k")
    assert [r["n"] for r in res["rows"]] == [1667, 1667, 1666]
    assert sqlbox.run_sql(spark, df, "SELECT * FROM data LIMIT 5000").count() == 1000
    with pytest.raises(ValueError):
        sqlbox.run_sql(spark, df, "DROP TABLE data")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 3 AS k").write.parquet(f"{tmp_path}/t")
    out = sqlbox.run_sql(spark, spark.read.parquet(f"{tmp_path}/t"), "SELECT id FROM dataset WHERE k = 1")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,1)" in plan
