"""URL filters: a sort-merge range join of urls with nested host rules (DataFrame functions only).

A host is written backwards, label by label, each followed by a dot (``www.example.org`` becomes
``org.example.www.``). A rule's host then covers the interval from its key to the same key with the last dot replaced
by the next character, ``/``; such intervals are nested or apart. Rules open and close at the ends of their intervals;
the stack of rules active after each such event is attached to it. Urls and events are range-partitioned by key and
swept in order: the last event before a url carries its stack of active rules. Among these, the rules whose path the
url's path starts with fit, and the longest (host and path together) wins; of equally long ones, block wins.

Scale: urls are dealt out by sampled ranges of (key, hash of the row), so a host that holds a third of all urls
is split over many tasks; the stack that is active where a range begins comes from a table of one row per range, the
only thing broadcast. The dealt-out rows are written to the shared folder, so that every reader sees the same ranges.

Defined cases: a null url, or one without ``://``, has an empty host and path and meets no rule; an empty rule table
leaves every url to ``default``; repeated urls and rules are harmless; rules with a null host, path or verdict are
left out. All input columns are kept; host, path, rule and verdict are added and replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm._text import written

#: Verdict, host and path (fixed by the contract).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "array<struct<n:int,verdict:string,rule:string,path:string>>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _events(rules: DataFrame) -> DataFrame:
    """One row per end of a rule host's interval: its key and the rules active from there on."""
    own = rules.where("host is not null and path is not null and verdict is not null").select(
        host_key(F.col("host")).alias("key"),
        F.struct((F.length("host") + F.length("path")).cast("int").alias("n"), F.col("verdict"), F.concat("host", "path").alias("rule"), F.col("path")).alias("r"))
    hosts = own.groupBy("key").agg(F.collect_set("r").alias("rules"))
    # a host's enclosing hosts are the prefixes of its key that end with a label
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    up = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("above"))
    stacks = up.join(hosts.select(F.col("key").alias("above"), "rules"), "above").groupBy("key").agg(
        F.flatten(F.collect_list("rules")).cast(_RULE).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("above") != F.col("key"), F.col("rules")))).cast(_RULE).alias("outside"))
    return stacks.select(F.explode(F.array(
        F.struct(F.col("key"), F.col("inside").alias("stack")),
        F.struct(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.col("outside").alias("stack")))).alias("e")).select("e.key", "e.stack")


def judge(pages: DataFrame, rules: DataFrame | None = None, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    host, path = host_and_path(F.col(url))
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    urls = pages.select(host.alias("host"), path.alias("path"), row.alias("row")).select(
        host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.xxhash64("row").alias("salt"), F.lit(None).cast(_RULE).alias("stack"), "host", "path", "row")
    events = _events(rules).select("key", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("salt"), "stack")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(urls.unionByName(events, allowMissingColumns=True).repartitionByRange(n, "key", "kind", "salt")
                    .withColumn("range", F.spark_partition_id()), "urls")
    # what is active where a range begins: one row per range
    ends = dealt.groupBy("range").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("left"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select("range", F.last("left", ignorenulls=True).over(before).alias("begin"))
    swept = dealt.withColumn("top", F.last("stack", ignorenulls=True).over(
        Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    active = swept.where("kind = 1").join(F.broadcast(begins), "range").withColumn("active", F.coalesce("top", "begin"))
    best = F.array_max(F.filter("active", lambda r: F.col("path").startswith(r["path"])))
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return active.withColumn("best", best).select(
        *kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
