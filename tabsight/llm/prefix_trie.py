"""Prefix trie of conversations, measured by the Euler-tour technique.

A conversation's first d turns are told by a 128-bit fingerprint: the exclusive or of hashes of (place, role, text), a
running sum that is cut into ranges. A node is a distinct fingerprint; its smallest member and its depth name it. Nodes
with the same smallest member hang one under another and form a path of the trie.

* Arcs: every node is entered and left once. The first child of a node is the next one of its path, then the paths that hang
  at it follow in a chain of siblings (in buckets, so that a node of very many children is no single window). That gives every
  arc its successor. Arcs of one path that follow one another without a branch between them (at most ``RUN`` nodes) are
  laid together into a run, which the list then holds as one element with the sum of its weights.
* List ranking: every eighth element, by hash, is a ruler. All others double their pointers until they meet a ruler; rulers
  form a list an eighth as long, which is ranked in the same way, down to ``SMALL`` elements that one task walks. An element's
  rank is the sum of the weights from it to the end of the tour, so differences of ranks are prefix sums over the tour.
* A subtree is the stretch from its top's entry to its exit: the leaves and the savings in it are the difference of the two ranks.

Scale: texts are read once and become fingerprints before anything is shuffled. A first turn that a third of all
conversations share is summed on the map side; joins on a node have its row on one side and Spark splits the other. The
list has no hot keys, as every element has one successor. Every round is written to the shared folder.

Defined cases: null role or text is empty; null turns come first; equal turns are ordered by fingerprint; rows without a conv_id
belong to no conversation and are left out; repeated rows are turns of their own; texts of any length are whole; conversations
without turns after rebuilding are members of the root; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm._order import positions, sha256_in_order
from tabsight.llm._text import written

#: Conversations that begin with turns of the same one.
GROUP = 20
#: One more than the most turns taken from it.
HEADS = 4
#: Nodes of a path that are windows of their own.
RUN = 1024
#: Buckets of a node's children, bits of the ids in one piece of a hash, elements that one task may walk, and of how many one is a ruler.
BUCKETS, IDS, SMALL, RULER = 256, 12, 16_384, 8
_WEIGHTS = ("arcs", "leaves", "tokens")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, two fingerprints of role and text, words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("f1"), F.xxhash64(F.lit(2), role, text).alias("f2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id), and their turns after rebuilding: conv_id, part, depth from 1, f1, f2, words."""
    placed, parts = positions(_turns(conversations), "conv_id", [F.col("turn").asc_nulls_first(), F.col("f1"), F.col("f2")], "trie-turns")
    parts = written(parts, "trie-parts")
    base, h = F.col("conv_id") - F.col("conv_id") % GROUP, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", base.alias("base"), h.alias("h"))
    first = (placed.where((F.col("conv_id") % GROUP == 0)).join(parts.where((F.col("conv_id") % GROUP == 0) & (F.col("before") < HEADS - 1)), ["conv_id", "part"])
             .withColumn("pos", F.col("at") - F.col("first_at") + F.col("before")).where(F.col("pos") < HEADS - 1))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "f1", "f2", "words"))).alias("head"))
    convs = written(convs.join(heads, "base", "left").select("conv_id", "h", F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<struct<pos:bigint,f1:bigint,f2:bigint,words:bigint>>")).alias("head")), "trie-conversations")
    own = placed.join(parts.join(convs.select("conv_id", "h", F.size("head").alias("n_head")), "conv_id"), ["conv_id", "part"])
    own = own.withColumn("pos", F.col("at") - F.col("first_at") + F.col("before")).where("pos >= h").select(
        "conv_id", "part", (F.col("pos") - F.col("h") + F.col("n_head") + 1).alias("depth"), "f1", "f2", "words")
    taken = convs.select("conv_id", F.posexplode("head").alias("i", "t")).select(
        "conv_id", F.lit(-1).alias("part"), (F.col("i") + 1).cast("bigint").alias("depth"), "t.f1", "t.f2", "t.words")
    return convs.select("conv_id"), own.unionByName(taken)


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with the fingerprint of the turns up to it (k1, k2) and before it (p1, p2)."""
    rows = turns.select("conv_id", "part", "depth", "words", F.xxhash64(F.lit(3), "depth", "f1", "f2").alias("x1"), F.xxhash64(F.lit(4), "depth", "f1", "f2").alias("x2"))
    rows = written(rows, "trie-rebuilt")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
    sums = sums.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"y{i}").over(earlier), F.lit(0)).cast("bigint").alias(f"o{i}") for i in (1, 2)])
    here = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keys = {f"k{i}": F.bit_xor(f"x{i}").over(here).bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)}
    return rows.join(sums, ["conv_id", "part"]).withColumns(keys).select(
        "conv_id", "depth", "words", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of a whole (small) list: one row per element."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    col = {n: t.column(n).to_numpy(zero_copy_only=False) for n in ("conv", "k", *_WEIGHTS)}
    nxt = list(zip(t.column("to_conv").to_pylist(), t.column("to_k").to_pylist(), strict=True))
    place = {x: i for i, x in enumerate(zip(col["conv"].tolist(), col["k"].tolist(), strict=True))}
    to = [place[x] if x[0] is not None else -1 for x in nxt]
    start = set(range(len(to))) - set(to)
    order = []
    i = start.pop() if start else -1
    while i >= 0:
        order.append(i)
        i = to[i]
    out = {n: np.zeros(len(to), dtype=np.int64) for n in _WEIGHTS}
    at = np.array(order[::-1])
    for n in _WEIGHTS:
        out[n][at] = np.cumsum(col[n][at])
    yield pa.record_batch([pa.array(col["conv"]), pa.array(col["k"]), *[pa.array(out[n]) for n in _WEIGHTS]], names=["conv", "k", *_WEIGHTS])


def rank(elements: DataFrame, small: int = SMALL, level: int = 0) -> DataFrame:
    """Ranks of a list's elements: ``conv``, ``k`` (together its name) and, for every weight, the sum from it to the end.

    ``elements``: conv, k, to_conv, to_k (its successor; null: the end) and the weights ``arcs``, ``leaves``, ``tokens``.
    """
    if elements.count() <= small:
        return elements.repartition(1).mapInArrow(_walk, "conv bigint, k bigint, arcs bigint, leaves bigint, tokens bigint")

    def ruler(conv: Column | str, k: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.lit(level), conv, k), F.lit(RULER)) == 0
    own = written(elements.withColumn("open", F.col("to_conv").isNotNull() & ~ruler("to_conv", "to_k")), "trie-list")
    while not own.where("open").isEmpty():
        ahead = own.where(~ruler("conv", "k")).select(F.col("conv").alias("to_conv"), F.col("k").alias("to_k"), F.struct("to_conv", "to_k", "open", *_WEIGHTS).alias("ahead"))
        met = own.where("open").join(ahead, ["to_conv", "to_k"]).select(
            "conv", "k", F.col("ahead.to_conv").alias("to_conv"), F.col("ahead.to_k").alias("to_k"), *[(F.col(w) + F.col(f"ahead.{w}")).alias(w) for w in _WEIGHTS], "ahead.open")
        own = written(own.where("not open").unionByName(met), "trie-list")
    is_ruler = ruler("conv", "k")
    ranked = written(rank(own.where(is_ruler).drop("open"), small, level + 1), "trie-rulers")
    rest = own.where(~is_ruler).join(ranked.select(F.col("conv").alias("to_conv"), F.col("k").alias("to_k"), *[F.col(w).alias(f"{w}_on") for w in _WEIGHTS]), ["to_conv", "to_k"], "left")
    return ranked.unionByName(rest.select("conv", "k", *[(F.col(w) + F.coalesce(f"{w}_on", F.lit(0))).alias(w) for w in _WEIGHTS]))


def build(conversations: DataFrame, small: int = SMALL, run: int = RUN) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(conversations)
    prefixes = written(_prefixes(turns), "trie-prefixes")
    # nodes; the root's key is (0, 0, 0)
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = root.first()
    zero = F.lit(0).cast("bigint")
    nodes = prefixes.groupBy("depth", "k1", "k2").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.min(c).alias(c) for c in ("words", "p1", "p2")])
    nodes = written(nodes.unionByName(root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", zero.alias("words"), zero.alias("p1"), zero.alias("p2"))), "trie-nodes")
    root_conv = F.lit(top["conv_id"] if top else None).cast("bigint")

    # paths: nodes with the same smallest member; each but the root's hangs at a node of another path
    tops = nodes.groupBy("conv_id").agg(F.min_by(F.struct("depth", "p1", "p2"), "depth").alias("t")).where("t.depth > 0").select("conv_id", "t.*")
    above = nodes.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up"))
    hung = tops.where("depth > 1").join(above, ["depth", "p1", "p2"]).select("conv_id", "depth", "up").unionByName(
        tops.where("depth = 1").select("conv_id", "depth", root_conv.alias("up")))
    hung = written(hung.select("conv_id", "up", (F.col("depth") - 1).alias("up_depth"), F.pmod(F.xxhash64("conv_id"), F.lit(BUCKETS)).alias("bucket")), "trie-paths")
    ends = hung.groupBy("up", "up_depth", "bucket").agg(F.min("conv_id").alias("least"), F.max("conv_id").alias("most"), F.count(F.lit(1)).alias("n"))
    ends = ends.withColumn("then", F.lead("least").over(Window.partitionBy("up", "up_depth").orderBy("bucket")))
    branches = ends.groupBy("up", "up_depth").agg(F.min_by("least", "bucket").alias("child"), F.sum("n").alias("n_hung"))
    follow = hung.withColumn("sibling", F.lead("conv_id").over(Window.partitionBy("up", "up_depth", "bucket").orderBy("conv_id")))
    follow = follow.join(ends.select("up", "up_depth", F.col("most").alias("conv_id"), "then"), ["up", "up_depth", "conv_id"], "left").select(
        "conv_id", "up", "up_depth", F.coalesce("sibling", "then").alias("sibling"))

    # stretches of a path: at most ``run`` nodes, windows of their own
    nodes_at = nodes.join(branches.select(F.col("up").alias("conv_id"), F.col("up_depth").alias("depth"), "child", "n_hung"), ["conv_id", "depth"], "left")
    nodes_at = nodes_at.select("conv_id", "depth", F.floor(F.col("depth") / run).alias("stretch"), "k1", "k2", "n_convs", "child",
                               F.coalesce("n_hung", F.lit(0)).alias("n_hung"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens"))
    stretches = nodes_at.groupBy("conv_id", "stretch").agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.max_by(F.struct("child"), "depth")["child"].alias("child"))
    path = Window.partitionBy("conv_id").orderBy("stretch")
    stretches = stretches.select("conv_id", "stretch", "lo", "hi", F.lead("lo").over(path).alias("next_lo"), F.lag(F.struct("child")).over(path).alias("before"))
    stretches = stretches.join(follow, "conv_id", "left")
    here = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    mark = (F.col("depth") == F.col("hi")) | (F.col("n_hung") > 0)
    at = nodes_at.join(stretches, ["conv_id", "stretch"]).withColumn("n_children", F.col("n_hung") + ((F.col("depth") < F.col("hi")) | F.col("next_lo").isNotNull()).cast("int"))
    at = at.withColumns({
        "leaf": (F.col("n_children") == 0).cast("bigint"),
        "exit": F.min(F.when(mark, F.col("depth"))).over(here.rowsBetween(0, Window.unboundedFollowing)),
        "earlier_mark": F.max(F.when(mark, F.struct("depth", "child"))).over(here.rowsBetween(Window.unboundedPreceding, -1)),
    }).withColumns({
        "leaves_before": F.coalesce(F.sum("leaf").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "tokens_before": F.coalesce(F.sum("tokens").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    at = written(at.drop("k1", "k2", "n_hung").withColumn("mark", F.col("depth") == F.col("exit")), "trie-arcs")

    # runs of entries are named by (path, 2 * first depth), runs of exits by (path, 2 * first depth + 1)
    def enter(conv: str | Column, depth: Column) -> Column:
        return F.struct(F.col(conv).alias("to_conv") if isinstance(conv, str) else conv.alias("to_conv"), (2 * depth).alias("to_k"))

    def leave(conv: str, depth: Column) -> Column:
        return F.struct(F.col(conv).alias("to_conv"), (2 * depth + 1).alias("to_k"))
    hi, lo, depth = F.col("hi"), F.col("lo"), F.col("depth")
    first_child = F.max(F.when(depth == hi, F.struct("child")))["child"]
    entries = at.groupBy("conv_id", "stretch", "lo", "hi", "next_lo").agg(F.count(F.lit(1)).alias("arcs"), F.sum("leaf").alias("leaves"), F.sum("tokens").alias("tokens"), first_child.alias("child"))
    entries = entries.select(F.col("conv_id").alias("conv"), (2 * lo).alias("k"), "arcs", "leaves", "tokens", F.when(F.col("next_lo").isNotNull(), enter("conv_id", F.col("next_lo")))
                             .when(F.col("child").isNotNull(), enter("child", hi + 1)).otherwise(leave("conv_id", hi)).alias("to"))
    low = F.coalesce(F.col("earlier_mark.depth") + 1, lo)
    inner = F.col("earlier_mark.depth").isNotNull()
    exits = at.where("mark").select(
        F.col("conv_id").alias("conv"), (2 * depth + 1).alias("k"), (depth - low + 1).alias("arcs"), zero.alias("leaves"), zero.alias("tokens"),
        F.when(inner, enter("earlier_mark.child", low))
        .when(F.col("before.child").isNotNull(), enter("before.child", lo)).when(F.col("before").isNotNull(), leave("conv_id", lo - 1))
        .when(F.col("sibling").isNotNull(), enter("sibling", lo)).when(F.col("up").isNotNull(), leave("up", F.col("up_depth"))).alias("to"))
    runs = entries.unionByName(exits).select("conv", "k", "arcs", "leaves", "tokens", "to.to_conv", "to.to_k")
    ranks = written(rank(written(runs, "trie-runs"), small), "trie-ranks")

    # subtrees: from a node's entry to its exit
    went_in = ranks.where("k % 2 = 0").select(F.col("conv").alias("conv_id"), F.shiftright("k", 1).alias("lo"), F.col("leaves").alias("leaves_in"), F.col("tokens").alias("tokens_in"))
    went_out = ranks.where("k % 2 = 1").select(F.col("conv").alias("conv_id"), F.shiftright("k", 1).alias("exit"), F.col("leaves").alias("leaves_out"), F.col("tokens").alias("tokens_out"))
    measured = at.join(went_in, ["conv_id", "lo"]).join(went_out, ["conv_id", "exit"])
    digests = _ends(prefixes, convs, nodes)
    inside = (depth > lo) | F.col("before").isNotNull()
    return measured.join(digests, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.when(inside, F.col("conv_id")).otherwise(F.col("up")).alias("parent_conv_id"), "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
        (F.col("leaves_in") - F.col("leaves_before") - F.col("leaves_out")).alias("n_leaves"),
        (F.col("tokens_in") - F.col("tokens_before") - F.col("tokens_out")).alias("saved_tokens"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _ends(prefixes: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, depth of each node at which conversations end, and the hash of their ids."""
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("depth", "k1", "k2"), "depth").alias("l"))
    root = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("depth", "k1", "k2")])
    last = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("l", root).alias("l")).select("conv_id", "l.*")
    pieces = last.groupBy("depth", "k1", "k2", F.shiftright("conv_id", IDS).alias("piece")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    key = F.concat_ws(":", "depth", "k1", "k2")
    hashed = sha256_in_order(pieces.select(key.alias("key"), "piece", "ids"), "key", "piece", "ids", ",")
    return nodes.withColumn("key", key).join(hashed, "key").select("conv_id", "depth", "sha256")
