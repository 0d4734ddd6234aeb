"""Exact substring dedup with a sparse suffix array: bytes covered by a 50-byte string that also starts in a document
of a smaller id are removed.

Suffixes are taken at anchors only. An anchor is a position whose 24-byte string has the smallest hash among the 27
such strings of some 50-byte window; so every window holds an anchor, and equal windows hold it at the same place. What
an anchor can prove lies within 26 bytes before and after its string: the record of an anchor is its string, the bytes
after it, and the bytes before it.

1. Documents are packed into blocks, compressed, and written once. A block sends, for the anchors' strings in it, 32
   bits of hash to a bucket given by further bits; the bucket answers with one bit each: seen in another block. Anchors
   whose string no other document has are done (a false alarm of the hash costs work only).
2. For the other anchors the block sends each distinct record once, with the smallest id that has it, in order of
   leading tokens (8 bytes each). Buckets are ranges of leading tokens cut by sampled splitters. A bucket sorts its
   records by multikey quicksort: by the first token, then only tied rows by the next, and so on. Equal records,
   neighbours now, are repeats of the one with the smallest id; for distinct records that share the anchor's
   string, each of the 27 windows is compared by itself. Splitters cut between different leading tokens, and a window's
   records share them all, so nothing has to be compared across a boundary.
3. The answer, 27 bits per record, goes back to the block, which marks windows, then bytes.

Scale: texts are shuffled twice, as compressed blocks, to meet the answers; messages are arrays, not rows, so Spark's
rows number blocks times buckets. A string or record is sent once per block, however often it occurs there, so no
group of copies is large. Block and bucket sizes are bounded in bytes. Hashes compared for equality have 64 bits.

Defined cases: a null text is empty; a row with a null id neither loses nor removes bytes; rows that share an id don't
remove each other's bytes; texts under 50 bytes stay. Input columns other than id and text are not carried; the
result has n_bytes, spans (removed bytes, end exclusive) and kept (the remaining bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm._text import _BASE, _BYTE_VALUE, Chunk, answers, chunks, mix64, packed, power_of_two, written

LENGTH = 50
K = 24
#: Places of an anchor in a window.
WINDOWS = LENGTH - K + 1
SIDE = WINDOWS - 1
#: Bytes of text in a block, and for each bucket of hashes or of records.
BLOCK_BYTES = 4 << 20
HASH_BUCKET_BYTES = 32 << 20
RECORD_BUCKET_BYTES = 16 << 20
#: Blocks that splitters are sampled from, and the share of their anchors.
SAMPLED_BLOCKS, SAMPLED_SHARE = 64, 50

_TOKENS = (K + 2 * SIDE + 2 + 7) // 8
_U = np.uint64
_SEGMENT = 1 << 15
_BLOCKS = "block bigint, ids binary, known binary, lens binary, n_bytes bigint, data binary"
_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("body", pa.binary()), ("ids", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("reply", pa.binary())])


def _window_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the K bytes from each position on."""
    h, n, out, done = _BYTE_VALUE[b], 1, None, 0
    while True:
        if K & n:
            out = h if out is None else out[:len(h) - done] * _U(pow(_BASE, n, 1 << 64)) + h[done:]
            done += n
        if done == K:
            return mix64(out)
        h = h[:len(h) - n] * _U(pow(_BASE, n, 1 << 64)) + h[n:]
        n *= 2


def _sliding(a: np.ndarray, best) -> np.ndarray:
    """best over each WINDOWS consecutive entries."""
    n = 1
    while 2 * n <= WINDOWS:
        a, n = best(a[:len(a) - n], a[n:]), 2 * n
    return best(a[:len(a) - (WINDOWS - n)], a[WINDOWS - n:]) if n < WINDOWS else a


def anchors(c: Chunk, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors in ``c.raw`` and hashes of their strings, for the documents that have an id."""
    long_enough = known & (c.till - c.at >= LENGTH)
    step = np.zeros(len(c.raw) + 1, dtype=np.int8)
    step[c.at[long_enough]] += 1
    step[c.till[long_enough] - LENGTH + 1] -= 1
    valid = np.cumsum(step[:-1], dtype=np.int8) > 0  # a window starts here
    raw = np.concatenate([np.zeros(SIDE, np.uint8), c.raw, np.zeros(SIDE + K, np.uint8)])
    valid = np.concatenate([np.zeros(SIDE, bool), valid, np.zeros(1, bool)])
    where, what = [], []
    for s in range(0, len(c.raw), _SEGMENT):
        n = min(_SEGMENT, len(c.raw) - s)
        h = _window_hashes(raw[s:s + n + 2 * SIDE + K - 1])  # from s - SIDE on
        least = np.where(valid[s:s + n + SIDE], _sliding(h, np.minimum), _U(0))
        own = h[SIDE:SIDE + n]
        at = np.flatnonzero((_sliding(least, np.maximum) == own) & (own > 0))
        where.append(at + s)
        what.append(own[at])
    return np.concatenate([*where, np.zeros(0, np.int64)]), np.concatenate([*what, np.zeros(0, _U)])


def records(c: Chunk, at: np.ndarray) -> np.ndarray:
    """Tokens (big-endian numbers) of the anchors' records: string, bytes after, bytes before (nearest first), and
    how many there are of either; zero bytes where the document ends."""
    doc = np.searchsorted(c.at, at, "right") - 1
    before, after = np.minimum(at - c.at[doc], SIDE), np.minimum(c.till[doc] - at - K, SIDE)
    raw = np.concatenate([np.zeros(SIDE, np.uint8), c.raw, np.zeros(SIDE, np.uint8)])
    out = np.zeros((len(at), _TOKENS * 8), dtype=np.uint8)
    for i in range(0, len(at), 1 << 16):
        p = at[i:i + (1 << 16), None] + SIDE
        side = np.arange(SIDE)
        out[i:i + len(p), :K] = raw[p + np.arange(K)]
        out[i:i + len(p), K:K + SIDE] = raw[p + K + side] * (side < after[i:i + len(p), None])
        out[i:i + len(p), K + SIDE:K + 2 * SIDE] = raw[p - 1 - side] * (side < before[i:i + len(p), None])
    out[:, K + 2 * SIDE], out[:, K + 2 * SIDE + 1] = after, before
    return out.view(">u8").astype(np.uint64)


def multikey_order(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of tokens, and whether each row in that order differs from the one before."""
    order = np.argsort(t[:, 0])
    new = np.ones(len(order), dtype=bool)
    v = t[order, 0]
    new[1:] = v[1:] != v[:-1]
    for j in range(1, t.shape[1]):
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group = np.cumsum(new)[rows]
        v = t[order[rows], j]
        o = np.lexsort((v, group))
        order[rows], v = order[rows][o], v[o]
        new[rows[1:]] |= (rows[1:] == rows[:-1] + 1) & (group[1:] == group[:-1]) & (v[1:] != v[:-1])
    return order, new


def _unpacked(b: pa.RecordBatch, i: int) -> tuple[Chunk, np.ndarray, np.ndarray]:
    lens = np.frombuffer(b["lens"][i].as_py(), dtype=np.int64)
    data = zstandard.decompress(b["data"][i].as_py()) if len(lens) else b""
    ends = np.cumsum(lens)
    return Chunk(0, [data[e - n:e] for e, n in zip(ends, lens, strict=True)], None), np.frombuffer(b["ids"][i].as_py(), dtype=np.int64), np.frombuffer(b["known"][i].as_py(), dtype=bool)


def _pack(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            known = ~np.asarray(b["id"].is_null())
            ids = b["id"].fill_null(0).to_numpy()
            for c in chunks(b["text"], None, size):
                own = slice(c.first, c.first + c.n)
                lens = c.till - c.at
                data = b"".join(c.raw[a:e].tobytes() for a, e in zip(c.at, c.till, strict=True))
                yield pa.record_batch({"block": pa.array([block]), "ids": pa.array([packed(ids[own])], pa.binary()), "known": pa.array([packed(known[own])], pa.binary()),
                                       "lens": pa.array([packed(lens)], pa.binary()), "n_bytes": pa.array([int(lens.sum())]), "data": pa.array([zstandard.compress(data, 3)], pa.binary())})
                block += 1
    return pack


def _cut(v: np.ndarray, n_buckets: int) -> np.ndarray:
    """Sorted hashes: where each bucket begins and ends (a bucket is given by the highest bits)."""
    bits = n_buckets.bit_length() - 1
    return np.searchsorted(v >> _U(64 - bits) if bits else np.zeros(len(v), _U), np.arange(n_buckets + 1, dtype=np.uint64))


def _send_hashes(n_buckets: int):
    bits = n_buckets.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c, _, known = _unpacked(b, i)
                h = np.unique(anchors(c, known)[1])
                cut = _cut(h, n_buckets)
                low = (h >> _U(32 - bits)).astype(np.uint32)
                full = [k for k in range(n_buckets) if cut[k] < cut[k + 1]]
                yield pa.record_batch([pa.array([b["block"][i].as_py()] * len(full), pa.int64()), pa.array(full, pa.int64()),
                                       pa.array([packed(low[cut[k]:cut[k + 1]]) for k in full], pa.binary()), pa.array([None] * len(full), pa.binary())], schema=_MESSAGE)
    return send


def _answer_hashes(t: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, dtype=np.uint32) for x in t["body"].to_pylist()]
    v = np.sort(np.concatenate(parts))
    twice = np.unique(v[1:][v[1:] == v[:-1]])
    bits = [packed(np.packbits(np.isin(x, twice, assume_unique=True))) for x in parts]
    return pa.table([t["block"], t["bucket"], pa.array(bits, pa.binary())], schema=_REPLY)


def _seen_elsewhere(h: np.ndarray, replies: list[bytes] | None, n_buckets: int) -> np.ndarray:
    cut, out, k = _cut(h, n_buckets), np.zeros(len(h), dtype=bool), 0
    for i in range(n_buckets):
        if cut[i] < cut[i + 1]:
            out[cut[i]:cut[i + 1]] = np.unpackbits(np.frombuffer(replies[k], np.uint8), count=cut[i + 1] - cut[i])
            k += 1
    return out


def _distinct_records(c: Chunk, ids: np.ndarray, known: np.ndarray, replies: list[bytes] | None, n_buckets: int):
    """Anchors that another document shares: positions, ids, the number of each one's record, and the distinct records
    in order with the smallest id of each."""
    at, h = anchors(c, known)
    own = ids[np.searchsorted(c.at, at, "right") - 1] if len(at) else ids[:0]
    order = np.argsort(h)
    first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(at) else np.zeros(0, np.int64)
    if len(at):
        several = np.minimum.reduceat(own[order], first) != np.maximum.reduceat(own[order], first)
        wanted = np.zeros(len(at), dtype=bool)
        wanted[order] = np.repeat(_seen_elsewhere(h[order][first], replies, n_buckets) | several, np.diff(np.append(first, len(at))))
        at, own = at[wanted], own[wanted]
    t = records(c, at)
    if not len(at):
        return at, own, at, t, own
    order, new = multikey_order(t)
    number = np.empty(len(at), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return at, own, number, t[order[new]], np.minimum.reduceat(own[order], np.flatnonzero(new))


def _send_records(splitters: np.ndarray, n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, _, _, t, least = _distinct_records(*_unpacked(b, i), b["seen"][i].as_py(), n_buckets)
                cut = np.concatenate(([0], np.searchsorted(t[:, 0], splitters), [len(t)]))
                full = [k for k in range(len(cut) - 1) if cut[k] < cut[k + 1]]
                yield pa.record_batch([pa.array([b["block"][i].as_py()] * len(full), pa.int64()), pa.array(full, pa.int64()),
                                       pa.array([packed(t[cut[k]:cut[k + 1]].astype(">u8")) for k in full], pa.binary()), pa.array([packed(least[cut[k]:cut[k + 1]]) for k in full], pa.binary())], schema=_MESSAGE)
    return send


def _windows_seen(t: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct records: bits of the windows that fit into the document, and of those that also occur in another record of a
    smaller id."""
    raw = t.astype(">u8").view(np.uint8).reshape(len(t), -1)
    after, before = raw[:, K + 2 * SIDE].astype(np.int64), raw[:, K + 2 * SIDE + 1].astype(np.int64)
    whole, seen = np.zeros(len(t), dtype=np.uint32), np.zeros(len(t), dtype=np.uint32)
    for j in range(WINDOWS):
        whole |= ((j <= before) & (SIDE - j <= after)).astype(np.uint32) << np.uint32(j)
    lead = t[:, :K // 8]
    new = np.concatenate(([True], (lead[1:] != lead[:-1]).any(1)))
    group = np.cumsum(new) - 1
    rows = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(rows):
        r, own, g = raw[rows], least[rows], mix64(group[rows].astype(np.uint64) + _U(1))
        right = [g]  # hash of the first 0, 1, ... bytes after
        for i in range(SIDE):
            right.append(right[-1] * _U(_BASE) + _BYTE_VALUE[r[:, K + i]])
        left = np.zeros(len(rows), dtype=np.uint64)
        for j in range(WINDOWS):
            fits = np.flatnonzero((whole[rows] >> np.uint32(j)) & np.uint32(1))
            if len(fits):
                key = mix64(mix64(left[fits]) + right[SIDE - j][fits])
                order = np.argsort(key)
                first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
                low = np.repeat(np.minimum.reduceat(own[fits][order], first), np.diff(np.append(first, len(fits))))
                hit = fits[order[low < own[fits][order]]]
                seen[rows[hit]] |= np.uint32(1 << j)
            if j < SIDE:
                left = left * _U(_BASE) + _BYTE_VALUE[r[:, K + SIDE + j]]
    return whole, seen


def _answer_records(t: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, dtype=">u8").reshape(-1, _TOKENS) for x in t["body"].to_pylist()]
    ids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in t["ids"].to_pylist()])
    tokens = np.concatenate(parts).astype(np.uint64)
    order, new = multikey_order(tokens)
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[order], first)
    whole, seen = _windows_seen(tokens[order[first]], least)
    number = np.empty(len(ids), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    bits = np.where(ids > least[number], whole[number], seen[number])
    cut = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return pa.table([t["block"], t["bucket"], pa.array([packed(bits[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], schema=_REPLY)


_RESULT = "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _remove(n_buckets: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c, ids, known = _unpacked(b, i)
                at, own, number, t, least = _distinct_records(c, ids, known, b["seen"][i].as_py(), n_buckets)
                gone = np.zeros(len(c.raw), dtype=bool)
                if len(at):
                    bits = np.frombuffer(b"".join(b["bits"][i].as_py()), dtype=np.uint32)
                    raw = t.astype(">u8").view(np.uint8).reshape(len(t), -1)
                    after, before = raw[:, K + 2 * SIDE].astype(np.int64), raw[:, K + 2 * SIDE + 1].astype(np.int64)
                    step = np.zeros(len(c.raw) + 1, dtype=np.int32)
                    later = own > least[number]  # the block itself holds the record in a smaller document
                    for j in range(WINDOWS):
                        fits = ((j <= before) & (SIDE - j <= after))[number]
                        start = at[fits & (later | ((bits[number] >> np.uint32(j)) & np.uint32(1)).astype(bool))] - j
                        np.add.at(step, start, 1)
                        np.add.at(step, start + LENGTH, -1)
                    gone = np.cumsum(step[:-1]) > 0
                edges = np.flatnonzero(gone[1:] != gone[:-1]) + 1
                start, end = edges[0::2], edges[1::2]
                doc = np.searchsorted(start, np.append(c.at, len(c.raw)))
                spans = [[{"start": int(x - c.at[d]), "end": int(y - c.at[d])} for x, y in zip(start[doc[d]:doc[d + 1]], end[doc[d]:doc[d + 1]], strict=True)] for d in range(c.n)]
                kept = [c.raw[a:e][~gone[a:e]].tobytes() for a, e in zip(c.at, c.till, strict=True)]
                yield pa.record_batch([pa.array(np.where(known, ids, 0), mask=~known), pa.array(c.till - c.at), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                                      names=["id", "n_bytes", "spans", "kept"])
    return remove


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            c, _, known = _unpacked(b, i)
            t = records(c, anchors(c, known)[0][::SAMPLED_SHARE])
            yield pa.record_batch({"lead": pa.array([packed(t[:, 0])], pa.binary())})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, n_bytes, spans (removed) and kept of each row of ``docs``."""
    spark = docs.sparkSession
    blocks = written(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(_pack(block_bytes), _BLOCKS), "blocks", "uncompressed")
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_hash, n_record = power_of_two(size / HASH_BUCKET_BYTES), max(1, round(size / RECORD_BUCKET_BYTES))
    # a bounded sample: some blocks' anchors, a few of each
    chosen = [r["block"] for r in blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLED_BLOCKS).collect()]
    some = blocks.where(F.col("block").isin(chosen)).mapInArrow(_sample, "lead binary").collect() if chosen else []
    lead = np.sort(np.concatenate([np.frombuffer(r["lead"], dtype=np.uint64) for r in some] or [np.zeros(0, np.uint64)]))
    splitters = np.unique(lead[np.arange(1, n_record) * len(lead) // n_record]) if len(lead) else lead

    message = "block bigint, bucket bigint, body binary, ids binary"
    reply = "block bigint, bucket bigint, reply binary"
    seen = blocks.mapInArrow(_send_hashes(n_hash), message).groupBy("bucket").applyInArrow(_answer_hashes, reply)
    seen = written(answers(seen, "seen"), "seen")
    known = blocks.join(seen, "block", "left")
    bits = known.mapInArrow(_send_records(splitters, n_hash), message).groupBy("bucket").applyInArrow(_answer_records, reply)
    bits = written(answers(bits, "bits"), "bits")
    return known.join(bits, "block", "left").mapInArrow(_remove(n_hash), _RESULT)
