"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

A document's set holds the 64-bit fingerprints of its distinct 5-word shingles. Documents of equal sets are one node
(nodes are what is compared; copies are never expanded into pairs). A node's signature has 256 symbols of 8 bits, each
the low byte of a MinHash. The first symbols are cut into chunks of six; of two signatures that differ in at most
2 * chunks - 1 of these symbols, some chunk differs in at most one (pigeonhole). So the index has, for each chunk
and each place of one allowed error, the chunk without that place: all pairs under that distance share a key. The number
of chunks is chosen so that a pair at the similarity threshold has no chunk with at most one error with
probability under ``miss``.

Keys with several nodes are worked on in two rounds, neither of which writes all pairs of a key:

1. Every node is compared with the smallest node that any of its keys holds; components of the links found are joined.
2. In keys that still hold several components, members of different components are compared by their whole
   signatures (numpy, in blocks of 512 by 512 members, so that a key of any size is split over tasks). Pairs no
   farther apart than five standard deviations beyond what the threshold similarity gives are candidates; each pair is
   looked at in the first key it shares only. A pair of blocks is then one unit of confirmation: it gets the texts of its
   members once, and confirms its candidates from the nearest on, leaving out those that its links have joined by then.

3. What the index leaves out (pairs with two errors in every chunk, or beyond the distance) is found exactly. Shingles
   are ordered by how often all texts hold them (a table of counts by hash, then the hash); two sets of similarity x / y share
   one of the first n - ceil(x * n / y) + 1 of each (n: its size), so these are keys too. In keys that still hold several
   components, members of different ones are compared by size and by the parities of their shingles in 2,048 slots: those
   differ in no more slots than the sets differ in shingles, so no similar pair is dropped. A key's members of its
   largest component are never compared with each other; a pair that shares one of the 16 smallest keys of both
   is looked at in the smallest of these only. The pairs left are confirmed like those of round 2.

Links are confirmed on the full sets, computed from whole texts. Components come from alternating large-star and
small-star steps, as Spark joins. Nothing but counts reaches the driver.

Scale: three narrow passes over the texts (sets, counts, first shingles), two semi-joins that fetch the candidates' texts, and shuffles
of keys (16 bytes for each of some 60 keys a node, and for 15 or 20 % of its shingles) and of candidates. A hot key is
pre-aggregated in round 1 and cut into blocks in rounds 2 and 3; a hot partner is salted in the confirmation. The counts have a fixed
size (a megabyte), which the driver passes on; no join broadcasts a side, as all of them grow with the input. Rows go to Python in batches of 2 MB, so a worker holds a few megabytes of texts.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; texts
with fewer than five words have one shingle; rows of equal text are one node whatever their ids; a row with a
null id is linked with nothing and kept (its component is null). All input columns are kept; n_shingles, component_id
and kept are added and replace columns of these names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from tabsight.llm._text import NON_SPACE, chunks, grams, mix64, ranges, shuffled, small_batches, written

WORDS = 5
THRESHOLD = (85, 100)
SYMBOLS = 256
CHUNK = 6
MISS = 1e-6
#: Members of a key compared in one go; larger keys are cut into pairs of blocks.
BLOCK = 512
#: Bytes of rows handed to Python in one go, and pairs compared by parities in one go.
BATCH_BYTES = 1 << 21
PAIRS = 1 << 14
#: Pairs of one partner confirmed in one group.
GROUP = 256
#: Counts of shingles by the first bits of their hash, in this many rows; they set an order only, so collisions do no harm.
SLOT_BITS = 20
SLOT_ROWS = 256
#: Slots whose parities bound the difference of two sets.
PARITIES = 2048
#: Keys a node carries so that a pair with several common keys is looked at once.
HEADS = 16

_A = (mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_B = mix64(np.arange(SYMBOLS + 1, 2 * SYMBOLS + 1, dtype=np.uint64)).astype(np.uint32)
_NODE = "struct<n:bigint,digest:binary,sig:binary,odd:binary>"
_NODE_ARROW = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary()), ("odd", pa.binary())])


def n_chunks(threshold: tuple[int, int] = THRESHOLD, miss: float = MISS) -> int:
    p = _symbol_error(threshold)
    return min(SYMBOLS // CHUNK, math.ceil(math.log(miss) / math.log(1 - (1 - p) ** CHUNK - CHUNK * p * (1 - p) ** (CHUNK - 1))))


def _symbol_error(threshold: tuple[int, int]) -> float:
    return (1 - threshold[0] / threshold[1]) * 255 / 256


def max_distance(threshold: tuple[int, int] = THRESHOLD) -> int:
    p = _symbol_error(threshold)
    return math.floor(SYMBOLS * p + 5 * math.sqrt(SYMBOLS * p * (1 - p)))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle fingerprints of each text."""
    for c in chunks(texts, NON_SPACE):
        h = c.hashes()
        for d in range(c.n):
            s = np.sort(grams(h[c.ptr[d]:c.ptr[d + 1]], WORDS))
            yield s[np.append(True, s[1:] != s[:-1])] if len(s) else s


def min_symbols(s: np.ndarray) -> np.ndarray:
    x, least = s.astype(np.uint32), np.full(SYMBOLS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, (x[i:i + 2048, None] * _A + _B).min(0))
    return (least & 0xFF).astype(np.uint8)


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def odd_slots(s: np.ndarray) -> bytes:
    """A bit for each slot: whether it has an odd number of the shingles. Two sets differ in at least as many shingles as bits."""
    return np.packbits(np.bincount((s % np.uint64(PARITIES)).astype(np.intp), minlength=PARITIES) & 1).tobytes()


def _node(texts: pa.Array) -> pa.Array:
    return pa.array([{"n": len(s), "digest": _digest(s), "sig": min_symbols(s).tobytes() if len(s) else None, "odd": odd_slots(s) if len(s) else None} for s in shingle_sets(texts)], _NODE_ARROW)


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint8).reshape(-1, SYMBOLS)


def index_keys(m: np.ndarray, n: int) -> np.ndarray:
    """n * CHUNK keys of each signature."""
    part = m[:, :n * CHUNK].reshape(-1, n, CHUNK).astype(np.uint64)
    whole = (part << (np.arange(CHUNK, dtype=np.uint64) * np.uint64(8))).sum(2, dtype=np.uint64)[:, :, None]
    without = whole & ~(np.uint64(0xFF) << (np.arange(CHUNK, dtype=np.uint64) * np.uint64(8)))
    tag = np.arange(n * CHUNK, dtype=np.uint64).reshape(1, n, CHUNK) << np.uint64(8 * CHUNK)
    return mix64(without | tag).reshape(len(m), -1).view(np.int64)


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOT_BITS)).astype(np.intp)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
    for b in batches:
        for s in shingle_sets(b["text"]):
            np.add.at(counts, _slots(s), np.uint32(1))
    if counts.any():
        yield pa.record_batch({"part": pa.array(range(SLOT_ROWS), pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(counts, SLOT_ROWS)], pa.binary())})


def _sum(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, dtype=np.uint32).astype(np.uint64) for x in t["counts"].to_pylist())
    level = np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8)
    return pa.table({"part": t["part"][:1], "levels": pa.array([level.tobytes()], pa.binary())})


def levels(own: DataFrame) -> np.ndarray:
    """How common the shingles of each slot are (text), on a scale of logarithms."""
    rows = own.select("text").mapInArrow(_count, "part int, counts binary").groupBy("part").applyInArrow(_sum, "part int, levels binary")
    out = np.zeros((SLOT_ROWS, (1 << SLOT_BITS) // SLOT_ROWS), dtype=np.uint8)
    for r in rows.collect():
        out[r.part] = np.frombuffer(r.levels, dtype=np.uint8)
    return out.reshape(-1)


def first_shingles(s: np.ndarray, level: np.ndarray, threshold: tuple[int, int]) -> np.ndarray:
    """The rarest of a set, so many that similar sets have one of them in common."""
    if not len(s):
        return s
    return s[np.argsort(level[_slots(s)], kind="stable")[:len(s) - -(-threshold[0] * len(s) // threshold[1]) + 1]]


def _first_of(level: np.ndarray, threshold: tuple[int, int]):
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, keys = [], []
            for s in shingle_sets(b["text"]):
                digests.append(_digest(s))
                keys.append(first_shingles(s, level, threshold).view(np.int64))
            yield pa.record_batch({"id": b["id"], "digest": pa.array(digests, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})
    return first


def _keys_of(n: int):
    def keys(sigs: pa.Array) -> pa.Array:
        k = index_keys(_matrix(sigs), n)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.reshape(-1)))
    return F.arrow_udf(keys, "array<bigint>")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of each group; the batches are sorted by group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[-1][c][-1] != b[c][0] for c in by):
            yield pa.Table.from_batches(held)
            held = []
        change = np.zeros(b.num_rows - 1, dtype=bool)
        for c in by:
            v = b[c].to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            held.append(b.slice(i, j - i))
            if j < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _confirmer(threshold: tuple[int, int]):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, np.zeros(0, dtype=np.uint64)
        for b in batches:
            out_a, out_b = [], []
            for a, salt, node, role, s in zip(b["a"].to_pylist(), b["salt"].to_pylist(), b["node"].to_pylist(), b["role"].to_pylist(), shingle_sets(b["text"]), strict=True):
                if not role:
                    current, own = (a, salt), s
                elif current == (a, salt):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if threshold[1] * both >= threshold[0] * (len(own) + len(s) - both):
                        out_a.append(a)
                        out_b.append(node)
            yield pa.record_batch({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar. ``texts``: node, text."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("salts"))
    dealt = pairs.join(shuffled(salts), "a").select("a", F.pmod(F.xxhash64("b"), "salts").alias("salt"), F.col("b").alias("node"), F.lit(1).alias("role"))
    heads = dealt.select("a", "salt", F.col("a").alias("node"), F.lit(0).alias("role")).distinct()
    rows = dealt.unionByName(heads).join(shuffled(texts), "node")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("a", "salt", "node", "role", "text").repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(_confirmer(threshold), "a bigint, b bigint").distinct()


_UNIT = "key bigint, i int, j int, a binary, b binary, nodes array<bigint>, comps array<bigint>"
_UNIT_ARROW = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("nodes", pa.list_(pa.int64())), ("comps", pa.list_(pa.int64()))])


def _comparer(n: int, most: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", "i", "j"]):
            m = _matrix(t["sig"].combine_chunks())
            node, comp, side = (t[c].to_numpy() for c in ("node", "comp", "side"))
            left, right = (np.arange(len(m)),) * 2 if t["i"][0] == t["j"][0] else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            key = t["key"][0].as_py()
            found, apart_by = [], []
            for a in range(0, len(left), 32):
                x = left[a:a + 32]
                apart = comp[x][:, None] != comp[right][None, :]
                if left is right:
                    apart &= x[:, None] < right[None, :]
                p, q = (w.astype(np.int64) for w in np.nonzero(apart))
                for s in range(0, len(p), 16384):
                    u, v = x[p[s:s + 16384]], right[q[s:s + 16384]]
                    wrong = m[u] != m[v]
                    distance = wrong.sum(1)
                    near = distance <= most
                    u, v, distance, wrong = u[near], v[near], distance[near], wrong[near, :n * CHUNK].reshape(-1, n, CHUNK)
                    if not len(u):
                        continue
                    # the first key that both have: first chunk with one error at most, at the error's place
                    chunk = (wrong.sum(2) <= 1).argmax(1)
                    place = wrong[np.arange(len(u)), chunk].argmax(1)
                    first = index_keys(m[u], n)[np.arange(len(u)), chunk * CHUNK + place] == key
                    found.append(np.column_stack([u, v])[first])
                    apart_by.append(distance[first])
            if not found or not sum(map(len, found)):
                continue
            pairs = np.concatenate(found)[np.argsort(np.concatenate(apart_by), kind="stable")]
            used = np.unique(pairs)
            pairs = np.searchsorted(used, pairs).astype(np.int32)
            yield pa.record_batch([t["key"][:1].combine_chunks(), t["i"][:1].combine_chunks(), t["j"][:1].combine_chunks(), pa.array([pairs[:, 0].tobytes()], pa.binary()), pa.array([pairs[:, 1].tobytes()], pa.binary()),
                                   pa.array([node[used]], pa.list_(pa.int64())), pa.array([comp[used]], pa.list_(pa.int64()))], names=["key", "i", "j", "a", "b", "nodes", "comps"])
    return compare


def _whole(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, many at a time; the batches are sorted by group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks()
        cut = _starts(t, by)[-1]
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(t: pa.Table, by: list[str]) -> np.ndarray:
    change = np.zeros(len(t) - 1, dtype=bool)
    for c in by:
        v = t[c].to_numpy()
        change |= v[1:] != v[:-1]
    return np.append(0, np.flatnonzero(change) + 1)


def _parity_comparer(threshold: tuple[int, int]):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, ["key", "i", "j"]):
            start = _starts(t, ["key", "i", "j"])
            sizes = np.diff(np.append(start, len(t)))
            group, till = np.repeat(np.arange(len(start)), sizes), np.repeat(start + sizes, sizes)
            key, i, j, side, node, comp, n = (t[c].to_numpy() for c in ("key", "i", "j", "side", "node", "comp", "n"))
            odd = np.frombuffer(b"".join(t["odd"].to_pylist()), dtype=np.uint64).reshape(-1, PARITIES // 64)
            lists = t["heads"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            many = lists.value_lengths().to_numpy()
            heads = np.repeat(key[:, None], HEADS, axis=1)
            heads[np.repeat(np.arange(len(t)), many), ranges(many)] = lists.flatten().to_numpy()
            # each row with the later ones of its group, some pairs at a time
            later = till - np.arange(len(t)) - 1
            cuts = np.unique(np.append(np.searchsorted(np.cumsum(later), np.arange(0, later.sum(), PAIRS)), len(t)))
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                u = np.repeat(np.arange(a, b), later[a:b])
                v = u + 1 + ranges(later[a:b])
                ok = (comp[u] != comp[v]) & ((i[u] == j[u]) | (side[u] != side[v])) & (threshold[1] * np.minimum(n[u], n[v]) >= threshold[0] * np.maximum(n[u], n[v]))
                u, v = u[ok], v[ok]
                # parities differ in no more slots than the sets in shingles
                distance = np.bitwise_count(odd[u] ^ odd[v]).sum(1, dtype=np.int64)
                ok = (threshold[1] + threshold[0]) * distance <= (threshold[1] - threshold[0]) * (n[u] + n[v])
                u, v, distance = u[ok], v[ok], distance[ok]
                # pairs that have a smaller key are looked at there
                met = np.zeros(len(u), dtype=bool)
                for h in range(HEADS):
                    x = heads[u, h]
                    met |= (x < key[u]) & (x[:, None] == heads[v]).any(1)
                found.append(np.column_stack([group[u], distance, u, v])[~met])
            if not found or not sum(map(len, found)):
                continue
            pairs = np.concatenate(found)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            out = []
            for x in np.split(pairs, np.flatnonzero(np.diff(pairs[:, 0])) + 1):
                used = np.unique(x[:, 2:])
                left, right = np.searchsorted(used, x[:, 2:]).astype(np.int32).T
                at = used[0]
                out.append({"key": key[at], "i": i[at], "j": j[at], "a": left.tobytes(), "b": right.tobytes(), "nodes": node[used], "comps": comp[used]})
            yield pa.RecordBatch.from_pylist(out, _UNIT_ARROW)
    return compare


def _unit_confirmer(threshold: tuple[int, int]):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", "i", "j"]):
            head = t.slice(0, 1)
            nodes, comps = head["nodes"][0].as_py(), head["comps"][0].as_py()
            sets = dict(zip(t["node"].to_pylist()[1:], shingle_sets(t["text"].combine_chunks().slice(1)), strict=True))
            joined: dict[int, int] = {}

            def root(c: int, joined=joined) -> int:
                while c in joined:
                    c = joined[c]
                return c
            out = []
            for a, b in zip(np.frombuffer(head["a"][0].as_py(), np.int32).tolist(), np.frombuffer(head["b"][0].as_py(), np.int32).tolist(), strict=True):
                x, y = root(comps[a]), root(comps[b])
                if x == y:
                    continue
                s, r = sets[nodes[a]], sets[nodes[b]]
                if threshold[1] * min(len(s), len(r)) < threshold[0] * max(len(s), len(r)):
                    continue
                both = len(np.intersect1d(s, r, assume_unique=True))
                if threshold[1] * both >= threshold[0] * (len(s) + len(r) - both):
                    joined[max(x, y)] = min(x, y)
                    out.append((comps[a], comps[b]))
            if out:
                yield pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    return confirm


def confirmed_units(units: DataFrame, texts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) between components, as the units' candidates join them."""
    by = ["key", "i", "j"]
    heads = units.select(*by, F.lit(None).cast("bigint").alias("node"), F.lit(None).cast("string").alias("text"), "a", "b", "nodes", "comps")
    members = units.select(*by, F.explode("nodes").alias("node")).join(shuffled(texts), "node")
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = heads.unionByName(members, allowMissingColumns=True).repartition(n, *by).sortWithinPartitions(*by, F.col("node").asc_nulls_first())
    return rows.mapInArrow(_unit_confirmer(threshold), "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of all nodes in ``links`` (a, b)."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    sums = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    state = edges.agg(*sums).first()
    while True:
        # large star: every larger neighbour is hung on the smallest of the neighbourhood
        sym = edges.union(edges.select("v", "u"))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = sym.where("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours are hung on the smallest of them
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        again = hung.join(shuffled(least), "u")
        edges = written(again.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(*sums).first()
        if now == state:
            return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
        state = now


def _texts(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of ``nodes`` (id, node, mark); rows of one id are told apart by the hash of their text."""
    rows = own.withColumn("mark", F.xxhash64("text")).join(shuffled(nodes.select("id", "mark", "node")), ["id", "mark"])
    return written(rows.dropDuplicates(["id", "node"]).select("node", "text"), "texts")


def left_out(own: DataFrame, nodes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) between the components (comp) of ``nodes`` that still have similar members, from all rows of ``own`` (id, text)."""
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = own.where("id is not null")
    first = rows.mapInArrow(_first_of(levels(own), threshold), rows.select("id").schema.add("digest", BinaryType()).add("keys", ArrayType(LongType())))
    keyed = first.join(shuffled(nodes.select("id", "digest", "node")), ["id", "digest"]).select("node", F.explode("keys").alias("key"))
    shared = keyed.withColumn("members", F.count("*").over(Window.partitionBy("key"))).where("members > 1").select("key", "node")
    index = written(shared.distinct(), "shared").join(shuffled(nodes.select("node", "comp")), "node")
    mixed = index.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = written(index.join(shuffled(mixed), "key").select("key", "node", "comp"), "open")
    # a key's largest component and its other members have blocks of their own; the former's are paired with the latter's only
    size = open_.groupBy("key", "comp").agg(F.count("*").alias("size")).groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("members"))
    size = size.select("key", F.col("top.comp").alias("top"), F.ceil((F.col("members") - F.col("top.size")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("top.size") / BLOCK).cast("int").alias("many"))
    heads = open_.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, HEADS).alias("heads"))
    marks = heads.join(shuffled(nodes.select("node", "n", "odd")), "node")
    dealt = open_.join(shuffled(size), "key").join(shuffled(marks), "node").withColumn("of_top", F.col("comp") == F.col("top")).withColumn(
        "own", F.when(F.col("of_top"), F.col("few") + F.pmod(F.hash("node"), "many")).otherwise(F.pmod(F.hash("node"), "few")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(F.col("of_top"), 0).otherwise(F.col("many"))))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "comp", "n", "odd", "heads")
    met = met.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    units = written(met.mapInArrow(_parity_comparer(threshold), _UNIT), "units")
    texts = _texts(own, nodes.join(shuffled(units.select(F.explode("nodes").alias("node")).distinct()), "node"))
    return confirmed_units(units, texts, threshold)


def classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, doc_id: str = "doc_id", text: str = "text", miss: float = MISS) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable over links) and kept of each row of ``docs``."""
    with small_batches(docs.sparkSession, BATCH_BYTES):
        return _classes(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), threshold, n_chunks(threshold, miss))


def _classes(own: DataFrame, threshold: tuple[int, int], n: int) -> DataFrame:
    spark = own.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = written(own.select("id", F.xxhash64("text").alias("mark"), F.arrow_udf(_node, _NODE)(F.col("text")).alias("x")).select("id", "mark", "x.*"), "sets")
    nodes = sets.where("id is not null and digest is not null").groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("of"), *[F.min(c).alias(c) for c in ("n", "sig", "odd")])
    nodes = written(nodes.select("digest", "of.*", "n", "sig", "odd").withColumn("node", F.monotonically_increasing_id()), "nodes")

    keyed = nodes.select("node", F.explode(_keys_of(n)(F.col("sig"))).alias("key"))
    several = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("members")).where("members > 1")
    index = written(keyed.join(shuffled(several), "key"), "index")
    texts = _texts(own, nodes.join(shuffled(index.select("node").distinct()), "node"))

    first = index.groupBy("node").agg(F.min("least").alias("a")).where("a < node").select("a", F.col("node").alias("b"))
    links = written(confirmed(first, texts, threshold), "confirmed")
    comps = components(links)
    index = index.join(shuffled(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = index.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    # a key's members fall into blocks; each pair of blocks is a group
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    open_ = index.join(shuffled(mixed), "key").join(shuffled(nodes.select("node", "sig")), "node").withColumn("blocks", blocks).withColumn("own", F.pmod(F.hash("node"), "blocks"))
    met = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "comp", "sig")
    met = met.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    units = written(met.mapInArrow(_comparer(n, max_distance(threshold)), _UNIT), "units")
    links = links.unionByName(confirmed_units(units, texts, threshold))

    comps = nodes.select("digest", "id", "mark", "node", "n", "odd").join(shuffled(components(links)), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    comps = written(comps, "comps")
    last = components(left_out(own, comps, threshold)).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    every = comps.join(shuffled(last), "comp", "left").select("digest", "id", F.coalesce("root", "comp").alias("comp"))
    named = every.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_set = every.join(shuffled(named), "comp").select("digest", "component_id")
    found = sets.join(shuffled(of_set), "digest", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)))


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_shingles, component_id and kept. Rows that share an id share the largest set's size and the
    smallest component."""
    found = classes(docs, threshold, doc_id, text).where("id is not null").groupBy(F.col("id").alias("_id")).agg(
        F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    rest = docs.drop("n_shingles", "component_id", "kept")
    both = rest.join(shuffled(found), rest[doc_id] == found["_id"], "left")
    return both.withColumn("kept", F.coalesce(F.col("component_id") == F.col("_id"), F.lit(True))).drop("_id")
