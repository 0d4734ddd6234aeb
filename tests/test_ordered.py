import random
import re

from pyspark.sql import functions as F

from tabsight.operators.ordered import order_statistic_cut, prefix_sum


def test_prefix_sum_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c"]), float(rng.randint(0, 50)), i, rng.randint(1, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, k double, id long, w long")
    out = prefix_sum(df, ["g"], "k", {"cum": "w"}, n_buckets=6, tiebreak=["id"]).collect()
    got = {r["id"]: r["cum"] for r in out}
    for g in "abc":
        part = sorted([r for r in rows if r[0] == g], key=lambda r: (r[1], r[2]))
        acc = 0
        for r in part:
            acc += r[3]
            assert got[r[2]] == acc


def test_prefix_sum_descending(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(100)], "k double, w int")
    got = {r["k"]: r["c"] for r in prefix_sum(df, [], "k", {"c": "w"}, ascending=False, n_buckets=5).collect()}
    assert got[99.0] == 1 and got[0.0] == 100 and got[50.0] == 50


def test_order_statistic_cut_with_heavy_timestamp(spark):
    rows = [(1 if i < 400 else i, i) for i in range(1000)]  # 40% of rows share one time value
    df = spark.createDataFrame(rows, "t long, key long")
    out = order_statistic_cut(df, "t", "key", 300)
    firsts = sorted(r["key"] for r in out.where(F.col("_first")).collect())
    assert firsts == list(range(300))


def test_null_groups_are_kept_on_the_bucketed_path(spark):
    from pyspark.sql import functions as F
    from tabsight.operators.ordered import prefix_sum
    df = spark.range(900).selectExpr("id", "case when id % 3 = 0 then null else cast(id % 3 as string) end as g")
    small = prefix_sum(df, ["g"], "id", {"s": F.lit(1)}, n_rows=900)
    for buckets in (8, 200):
        cut = prefix_sum(df, ["g"], "id", {"s": F.lit(1)}, n_buckets=buckets)
        assert sorted((r.id, r.g or "", r.s) for r in cut.collect()) == sorted((r.id, r.g or "", r.s) for r in small.collect())


def test_chronological_cut_with_text_keys(spark):
    from tabsight.operators import features
    df = spark.range(500).selectExpr("md5(cast(id as string)) as k", "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id div 100 as int)) as t")
    out = features.chronological_split(df, "t", "k", 0.25)
    assert out.where("split = 'train'").count() == 375 and out.where("split = 'test'").count() == 125


def test_blocked_lags_equal_one_window_with_null_series(spark):
    from tabsight.operators import features
    df = spark.range(600).selectExpr("case when id % 3 = 0 then null else id % 3 end as s", "timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as t", "cast(id as double) as y")
    one = features.lag_features(df, "t", "y", ["s"], lags=[1, 3], windows=[4])
    cut = features.lag_features(df, "t", "y", ["s"], lags=[1, 3], windows=[4], block_rows=50, max_series_rows=10)
    cols = ["s", "t", "y", "target_lag_1", "target_lag_3", "target_roll_mean_4", "target_roll_std_4"]
    key = lambda r: tuple(str(x) if not isinstance(x, float) else f"{x:.9g}" for x in r)
    assert sorted(map(key, one.select(cols).collect())) == sorted(map(key, cut.select(cols).collect()))


def test_rows_without_a_class_are_split_too(spark):
    from tabsight.operators import split
    df = spark.range(300).selectExpr("id", "case when id % 3 = 0 then null else cast(id % 3 as string) end as c")
    assert split.holdout_split(df, "id", "c").count() == 300


def test_rows_of_a_group_are_not_sent_to_one_task(spark):
    from tabsight.operators import explain
    from tabsight.operators.ordered import exact_quantiles_from_counts, with_value_bucket
    vc = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).alias("_cnt"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (with_value_bucket(vc, ["g"], "x"), exact_quantiles_from_counts(vc, ["g"], "x", [0.5])):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\(coalesce\(g#\d+L?, [^,]*\), isnull\(g#\d+L?\), \d+\)", plan), plan
        assert {r["g"]: r["q"] for r in exact_quantiles_from_counts(vc, ["g"], "x", [0.5]).collect()} == {0: 1999.0, 1: 2000.0}
        rows = explain.permuted(spark.range(50).select("id", (F.col("id") * 2).alias("v")), "id", ["v"])
        assert rows.groupBy(explain.PERMUTED).agg(F.sum("v").alias("s"), F.count_distinct("id").alias("n")).where("s = 2450 and n = 50").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
