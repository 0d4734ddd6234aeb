"""Mixing sources to target weights: hierarchical budgeting over domains, languages and sources.

The tree's root holds the wanted number of tokens. Going down, each node deals its budget to its children by weight; a
child that cannot use its share (all its tokens times ``max_epochs``) takes what it can, and what it leaves goes to
its siblings by weight. As a node's capacity is that of all its leaves, a shortage reaches a node's own siblings, and
so its ancestors' other branches, only when all its children are full. A leaf's budget is then whole epochs over its
documents, and, in the order of one more epoch, the longest prefix of documents that fits the rest. An epoch's order is
that of md5(seed:epoch:doc_id).

Budgets are whole tokens; shares are rounded down (a node loses fewer tokens than it has children).

Scale: tokens are counted in one pass over the texts; all further work is on a narrow table. A leaf's prefix is
found with a histogram of 4,096 ranges of the order key per leaf, aggregated before the shuffle; only the range that
the budget ends in is sorted. A leaf with a third of all rows is thus never in one task. Tables of one row per leaf are broadcast
if they are counted to be small.

Defined cases: a null domain, language or source counts as the empty name; null text has no tokens, and a document
without tokens gets copies like any other in its place of the order (it costs nothing; no prefix is begun for a rest of 0); equal ids are ordered by a hash of their text; a node of
weight 0 gets nothing; an empty table yields no rows. Input columns other than the text are kept, whatever their names, as
each row travels as one struct; domain, n_tokens and n_copies are added and replace columns of these names (in any case).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm._text import shuffled, written

SEED = 42
MAX_EPOCHS = 3
#: Wanted tokens as a share of all tokens, in percent.
TARGET_PERCENT = 60
#: Weights by name, at any place in the tree; other nodes have DEFAULT_WEIGHT.
DOMAIN_WEIGHTS = {"curated": 6, "web": 3, "crawl": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 2}
DEFAULT_WEIGHT = 1
_LEVELS = ("_domain", "_lang", "_source")
_PREFIX = 3  # hexadecimal digits of the order key: 4,096 ranges
#: Tables of one row per leaf are broadcast up to this many leaves; beyond, Spark joins them by shuffling.
BROADCAST_LEAVES = 50_000


def source_domain(source: Column) -> Column:
    """Domain of a source: ``src0`` is crawled, sources up to 9 are web sites, the others are curated."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    return F.when(n == "", "crawl").when(n == "0", "crawl").when(F.length(n) == 1, "web").otherwise("curated")


def _domain(domain: Column | Mapping[str, str] | None, source: Column) -> Column:
    if domain is None:
        return source_domain(source)
    if isinstance(domain, Mapping):
        own = source.cast("string")
        named = F.create_map(*[F.lit(x) for pair in sorted(domain.items()) for x in pair]) if domain else F.lit(None).cast("map<string,string>")
        return F.coalesce(F.try_element_at(named, F.coalesce(own, F.lit(""))), own)
    return domain


def _weight(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for k, w in sorted(weights.items(), reverse=True):
        out = F.when(name == k, w).otherwise(out)
    return out.cast("bigint")


def deal(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``children`` (parents, name, cap, w, budget of the parent) with ``got``: their part of the budget.

    Children in order of cap / w: one is full if its share of what the earlier ones leave reaches its capacity.
    """
    big = "decimal(38,0)"
    own = Window.partitionBy(*parents)
    order = own.orderBy((F.col("cap") / F.col("w")).asc_nulls_last(), name)
    cap, w, budget = F.col("cap").cast(big), F.col("w").cast(big), F.col("budget").cast(big)
    usable = F.when(F.col("w") > 0, F.col("cap")).otherwise(0)
    return (
        children.withColumn("cap", usable).withColumn("w", F.nullif("w", F.lit(0)))
        .withColumn("earlier", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("later_w", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", F.col("w").isNull() | (cap * F.col("later_w").cast(big) <= w * (budget - F.col("earlier").cast(big))))
        .withColumn("left", budget - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(own).cast(big))
        .withColumn("left_w", F.sum(F.when(~F.col("full"), F.col("w"))).over(own).cast(big))
        .withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(w as decimal(18,0)) * left div left_w")).cast("bigint"))
        .drop("earlier", "later_w", "full", "left", "left_w")
    )


def budgets(leaves: DataFrame, target: int, max_epochs: int, domain_weights: Mapping[str, int], lang_weights: Mapping[str, int],
            source_weights: Mapping[str, int]) -> DataFrame:
    """Leaves (three names, tokens) with ``got`` of ``target`` tokens."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    weights = (domain_weights, lang_weights, source_weights)
    up, budget = [], None
    for depth, level in enumerate(_LEVELS):
        names = [*up, level]
        nodes = leaves.groupBy(*names).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(F.col(level), weights[depth]))
        nodes = nodes.join(budget, up) if up else nodes.withColumn("budget", F.lit(target).cast("bigint"))
        dealt = deal(nodes, up, level)
        budget, up = dealt.select(*names, F.col("got").alias("budget")), names
    return leaves.join(budget.withColumnRenamed("budget", "got"), up).select(*up, "tokens", "got")


def mix(docs: DataFrame, domain: Column | Mapping[str, str] | None = None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", source: str = "source",
        target_percent: int = TARGET_PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS, lang_weights: Mapping[str, int] = LANG_WEIGHTS, source_weights: Mapping[str, int] | None = None) -> DataFrame:
    """Documents (without their text) with domain, n_tokens and n_copies: how often the mixture holds each.

    ``domain``: an expression, or the domain of each source by name (a source that it doesn't name is a domain of its own);
    by default ``source_domain`` of the source.
    """
    named = [F.coalesce(x.cast("string"), F.lit("")) for x in (_domain(domain, F.col(source)), F.col(lang), F.col(source))]
    kept = [c for c in docs.columns if c != text and c.lower() not in ("n_tokens", "n_copies", "domain")]
    row = F.struct(F.lit(0).alias("c"), *[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(kept)])
    rows = docs.select(row.alias("_row"), F.col(doc_id).alias("_id"), *[n.alias(c) for n, c in zip(named, _LEVELS, strict=True)],
                       F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint").alias("n_tokens"),
                       F.xxhash64(F.col(text)).alias("_tie"))
    rows = written(rows, "mixing")
    leaves = rows.groupBy(*_LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    target = (rows.agg(F.sum("n_tokens")).first()[0] or 0) * target_percent // 100
    plan = budgets(leaves, target, max_epochs, domain_weights, lang_weights, source_weights or {}).select(
        *_LEVELS, F.when(F.col("tokens") > 0, F.expr("got div tokens")).otherwise(F.lit(max_epochs)).alias("_epochs"),
        F.when(F.col("tokens") > 0, F.col("got") % F.col("tokens")).otherwise(0).alias("_rest"))
    plan = written(plan, "mixing-plan")
    few = F.broadcast if plan.count() <= BROADCAST_LEAVES else shuffled
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_epochs").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    keyed = rows.join(few(plan), list(_LEVELS)).withColumn("_key", key).withColumn("_range", F.substring("_key", 1, _PREFIX))
    upto = Window.partitionBy(*_LEVELS).orderBy("_range")
    histogram = keyed.groupBy(*_LEVELS, "_range", "_rest").agg(F.sum("n_tokens").alias("_in")).withColumn("_upto", F.sum("_in").over(upto))
    # the first range that does not fit as a whole; what is left for it
    last = histogram.where("_upto > _rest").groupBy(*_LEVELS).agg(F.min(F.struct("_range", (F.col("_rest") - F.col("_upto") + F.col("_in")).alias("left"))).alias("_last"))
    dealt = keyed.join(few(last), list(_LEVELS), "left").withColumn("_edge", F.coalesce(F.col("_range") == F.col("_last._range"), F.lit(False)))
    inside = Window.partitionBy(*_LEVELS).orderBy("_key", "_tie", "_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = dealt.where("_edge").withColumn("_more", ((F.col("_rest") > 0) & (F.sum("n_tokens").over(inside) <= F.col("_last.left"))).cast("int"))
    rest = dealt.where("not _edge").withColumn("_more", F.when(F.col("_rest") > 0, F.coalesce((F.col("_range") < F.col("_last._range")).cast("int"), F.lit(1))).otherwise(0))
    return rest.unionByName(edge).select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(kept)], F.col("_domain").alias("domain"), "n_tokens", (F.col("_epochs") + F.col("_more")).cast("bigint").alias("n_copies"))
