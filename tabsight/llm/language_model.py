"""LM scoring: a log-bilinear neural model trained by noise-contrastive estimation, beside a unigram base score.

Tokens are words and one end per document. The vocabulary is every token that the training documents hold at least
``MIN_COUNT`` times, and one class of all others; it grows with the input. Each has a vector as context and one as target.
The vector predicted for the next token is the sum of the vectors of the two tokens before it, each weighted entry by
entry by a vector of its place. Targets, by falling frequency, are the leaves of a tree of three levels (classes, classes
inside them, tokens) whose nodes have a vector and a bias each; a node's score is its dot product with the predicted
vector, plus the bias. Training tells true nodes of each level from noise drawn from the tokens' frequencies (the same
noise for a batch, so that scores are matrix products). For scoring, each level is normalised exactly over the nodes
inside their parent, so the probabilities of all tokens sum to one. A token outside the vocabulary also costs its share of
that class by its count: (c + 1) / (tokens outside + their kinds + 1).

1. Documents are packed into blocks: the words' 64-bit fingerprints, and every document's words as numbers. A block
   sends its distinct words with their training counts to buckets of fingerprints; buckets add up and answer with the
   counts over all training documents. So every count covers the whole corpus, and what is shuffled grows with it.
2. Each task trains the model on the training documents of its blocks, one pass over all their tokens; the rows of the
   tables that a task touched go to buckets of rows as changes (a byte for each entry, with a scale for each row), which
   average them, weighted by how often each task met them. Buckets are cut by the rows that they may be sent.
3. Each block, joined with its answers, scores its documents with the averaged model.

Scale: texts are read once and not shuffled; blocks are shuffled once to meet their answers. A word is sent once per
block, however frequent. The vocabulary (16 bytes a token) and the averaged changes (66 bytes) pass through the
driver; every worker holds the tables (132 bytes a token), a training worker twice as much.

Defined cases: a null or empty text is one end token; a null id counts as the empty text when it is dealt to
training or held-out documents; without training documents there is one class, and every probability is that of
an unseen token; repeated rows count as often as they occur. Other input columns are not carried.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm._text import NON_SPACE, answers, chunks, packed, power_of_two, reuse, written

#: Tokens that the training documents hold less often are one class; entries of a vector.
MIN_COUNT, SIZE = 10, 16
BLOCK_BYTES = 4 << 20
#: Distinct words of blocks for each bucket.
BUCKET_WORDS = 2_000_000
#: Tokens trained on in one step; noise classes drawn for a step; step size (of Adagrad).
BATCH, NOISE, RATE = 4096, 64, 0.15
#: Changed rows that the tasks send to one bucket, about.
BUCKET_ROWS = 1 << 19

END = np.uint64(0x5EED0FE2D0C5E2D1)
_U = np.uint64
_BLOCKS = "block bigint, ids binary, known binary, held binary, n_words binary, words binary, counts binary, tokens binary, n_distinct bigint"
_WIDTH = SIZE + 1  # a node's vector, then its bias
_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("reply", pa.binary()), ("top", pa.binary()), ("top_n", pa.binary()), ("n", pa.int64()), ("kinds", pa.int64())])


def _tight(a: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte by byte of each."""
    return pa.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _loose(packed_numbers: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed_numbers, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(4, n).T.copy().view("<u4").reshape(n)


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct entries in order, and each entry's number among them; hashed, so that only distinct ones are sorted."""
    kinds = pa.array(h).dictionary_encode()
    words, number = kinds.dictionary.to_numpy(), kinds.indices.to_numpy()
    order = np.argsort(words)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return words[order], place[number]


def _pack(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            known, held = ~np.asarray(b["id"].is_null()), np.asarray(b["held"])
            ids = b["id"].fill_null(0).to_numpy()
            for c in chunks(b["text"], NON_SPACE, size):
                own = slice(c.first, c.first + c.n)
                n = np.diff(c.ptr)
                # every document's words, then its end
                h = np.insert(c.hashes(), c.ptr[1:], END)
                train = np.repeat(~held[own], n + 1)
                words, number = _numbered(h)
                counts = np.bincount(number[train], minlength=len(words)).astype(np.uint32)
                yield pa.record_batch({"block": pa.array([block]), "ids": pa.array([packed(ids[own])], pa.binary()), "known": pa.array([packed(known[own])], pa.binary()),
                                       "held": pa.array([packed(held[own])], pa.binary()), "n_words": pa.array([packed(n.astype(np.int64))], pa.binary()),
                                       "words": pa.array([packed(words)], pa.binary()), "counts": pa.array([packed(counts)], pa.binary()),
                                       "tokens": pa.array([_tight(number)], pa.binary()), "n_distinct": pa.array([len(words)])})
                block += 1
    return pack


def _cut(v: np.ndarray, n_buckets: int) -> np.ndarray:
    bits = n_buckets.bit_length() - 1
    return np.searchsorted(v >> _U(64 - bits) if bits else np.zeros(len(v), _U), np.arange(n_buckets + 1, dtype=np.uint64))


def _send(n_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, counts = np.frombuffer(b["words"][i].as_py(), np.uint64), np.frombuffer(b["counts"][i].as_py(), np.uint32)
                cut = _cut(words, n_buckets)
                full = [k for k in range(n_buckets) if cut[k] < cut[k + 1]]
                yield pa.record_batch([pa.array([b["block"][i].as_py()] * len(full), pa.int64()), pa.array(full, pa.int64()), pa.array([packed(words[cut[k]:cut[k + 1]]) for k in full], pa.binary()),
                                       pa.array([packed(counts[cut[k]:cut[k + 1]]) for k in full], pa.binary())], schema=_MESSAGE)
    return send


def _add_up(min_count: int):
    def add_up(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in t["words"].to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in t["counts"].to_pylist()])
        words, number = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(number, counts, minlength=len(words)).astype(np.int64)  # exact below 2**53
        cut = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        back = [packed(total[number[a:b]]) for a, b in zip(cut, cut[1:], strict=False)]
        often = total >= max(min_count, 1)
        m = len(parts)
        return pa.table([t["block"], t["bucket"], pa.array(back, pa.binary()), pa.array([packed(words[often])] + [None] * (m - 1), pa.binary()), pa.array([packed(total[often])] + [None] * (m - 1), pa.binary()),
                         pa.array([int(total.sum())] + [0] * (m - 1)), pa.array([int((total > 0).sum())] + [0] * (m - 1))], schema=_REPLY)
    return add_up


@dataclass
class Model:
    """``words``: sorted fingerprints of tokens 1, 2, ...; token 0 is all others. ``rank``: each token's leaf (by falling
    frequency); the leaf's node is leaf // fan ** 2 in ``outs[0]``, leaf // fan in ``outs[1]`` and the leaf itself in
    ``outs[2]``; ``shares``: the nodes' frequencies. ``before`` has the context vectors by leaf; its last row stands for the
    places before a document's start."""

    words: np.ndarray
    rank: np.ndarray
    fan: int
    shares: list[np.ndarray]
    before: np.ndarray
    places: np.ndarray
    outs: list[np.ndarray]

    @classmethod
    def fresh(cls, words: np.ndarray, share: np.ndarray) -> Model:
        draw, k, share = np.random.default_rng(1), len(share), share / share.sum()
        fan = max(2, math.ceil(k ** (1 / 3) - 1e-9))
        leaf = np.argsort(-share, kind="stable")
        rank = np.empty(k, np.int64)
        rank[leaf] = np.arange(k)

        def vectors(n: int) -> np.ndarray:
            v = draw.random((n, SIZE), np.float32)
            v -= np.float32(0.5)
            v *= np.float32(0.35)
            return v

        before, by_leaf = vectors(k + 1), share[leaf]
        shares = [np.add.reduceat(by_leaf, np.arange(0, k, width)) for width in (fan * fan, fan)] + [by_leaf]
        outs = [np.column_stack([vectors(len(part)), np.log(part).astype(np.float32)]) for part in shares]
        return cls(words, rank, fan, shares, before, np.array([[1.0], [0.5]], np.float32) * np.ones(SIZE, np.float32), outs)

    def classes(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(words), dtype=np.int64)
        i = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[i] == words, i + 1, 0)

    def contexts(self, c: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """The leaves of the two tokens before each token, nearest first."""
        k, start, leaf = len(self.rank), np.cumsum(n_words + 1) - (n_words + 1), self.rank[c]
        one, two = np.roll(leaf, 1), np.roll(leaf, 2)
        one[start], two[start] = k, k
        two[(start + 1)[n_words > 0]] = k
        return np.column_stack([one, two])

    def parts(self) -> list[np.ndarray]:
        return [self.places, self.before, *self.outs]

    def guess(self, r1: np.ndarray, r2: np.ndarray) -> np.ndarray:
        """Predicted vectors from those of the contexts, with a one for the bias."""
        g = np.empty((len(r1), _WIDTH), np.float32)
        np.multiply(r1, self.places[0], out=g[:, :SIZE])
        g[:, :SIZE] += r2 * self.places[1]
        g[:, SIZE] = 1
        return g

    def train(self, context: np.ndarray, target: np.ndarray, draw: np.random.Generator, slow: list[np.ndarray], met: list[np.ndarray] | None = None) -> None:
        """One pass of noise-contrastive steps, in random order. ``slow``: summed squares of slopes (Adagrad); ``met``: how
        often each row of ``parts()`` was trained."""
        drawn, widths = np.cumsum(self.shares[2]), (self.fan * self.fan, self.fan, 1)
        leaves, order = self.rank[target], draw.permutation(len(target))
        near, far = (np.ascontiguousarray(context[:, j]) for j in range(2))
        noise = np.minimum(np.searchsorted(drawn, draw.random((-(-len(target) // BATCH), NOISE)) * drawn[-1], side="right"), len(drawn) - 1)
        noise.sort(1)
        room = np.empty(BATCH * len(widths) * NOISE, np.float32)
        for i, noise_leaf in zip(range(0, len(order), BATCH), noise, strict=True):
            own = order[i:i + BATCH]
            own, leaf = _sorted(leaves.take(own), own)  # so every level's nodes are in order
            n, one, two = len(own), near.take(own), far.take(own)
            r1, r2 = self.before.take(one, axis=0), self.before.take(two, axis=0)
            guess = self.guess(r1, r2)
            # the noise of all levels side by side, a node that was drawn several times once, with that weight; the bias
            # column also takes off what noise alone would give
            false_rows, drawn_times = [], []
            for w in widths:
                node = noise_leaf // w
                first = _firsts(node)
                false_rows.append(node[first])
                drawn_times.append(np.diff(first, append=NOISE))
            false = np.concatenate([out.take(rows, axis=0) for out, rows in zip(self.outs, false_rows, strict=True)])
            weight = np.concatenate(drawn_times).astype(np.float32)[:, None]
            ask = -false
            ask[:, SIZE] += np.concatenate([np.log(NOISE * part[rows]) for part, rows in zip(self.shares, false_rows, strict=True)])
            # P(noise is true), in place: fresh arrays of this size cost more than the arithmetic
            wrong = np.matmul(guess, ask.T, out=room[:n * len(ask)].reshape(n, len(ask)))
            np.exp(wrong, out=wrong)
            wrong += 1
            np.reciprocal(wrong, out=wrong)
            d_guess, d_false = wrong @ (false * -weight), (wrong.T @ guess) * -weight
            end = 0
            for j, (out, part, w) in enumerate(zip(self.outs, self.shares, widths, strict=True)):
                node = leaf // w
                first = _firsts(node)
                rows = node[first]
                times = np.diff(first, append=n)
                true = out.take(node, axis=0)
                right = np.einsum("ij,ij->i", guess, true)
                right -= np.repeat(np.log(NOISE * part[rows]).astype(np.float32), times)
                right = (1 / (1 + np.exp(right)))[:, None]  # 1 - P(true node is true)
                true *= right
                d_guess += true
                _step(out, slow[2 + j], rows, _run_sums(guess * right, first) / n)
                start, end = end, end + len(false_rows[j])
                _step(out, slow[2 + j], false_rows[j], d_false[start:end] / n)
            d = d_guess[:, :SIZE]
            by, rows = _sorted(np.concatenate([one, two]), np.arange(2 * n))
            first = _firsts(rows)
            slopes = _run_sums(np.concatenate([d * self.places[0], d * self.places[1]]).take(by, axis=0), first)
            _step(self.before, slow[1], rows[first], slopes / n)
            _step(self.places, slow[0], np.arange(2), np.stack([np.einsum("ij,ij->j", d, r1), np.einsum("ij,ij->j", d, r2)]) / n)
        if met is not None:
            met[0] += len(target)
            np.add.at(met[1], context.reshape(-1), 1)
            for m, w in zip(met[2:], widths, strict=True):
                np.add.at(m, leaves // w, 1)
                np.add.at(m, noise.reshape(-1) // w, 1)

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of tokens."""
        if not len(target):
            return np.zeros(0)
        k = len(self.rank)
        pairs, which = np.unique(context[:, 0] * (k + 1) + context[:, 1], return_inverse=True)
        keys, back = np.unique(self.rank[target] * len(pairs) + which, return_inverse=True)  # in order of leaves
        leaf, which = keys // len(pairs), keys % len(pairs)
        guess, whole = np.empty((len(pairs), _WIDTH), np.float32), np.empty(len(pairs), np.float32)
        widths, step = (self.fan * self.fan, self.fan, 1), 1 << 14
        for i in range(0, len(pairs), step):
            one, two = np.divmod(pairs[i:i + step], k + 1)
            guess[i:i + step] = self.guess(self.before.take(one, axis=0), self.before.take(two, axis=0))
        long = _longest(guess)
        small = [_small(long, out) for out in self.outs]
        _log_sums(guess, self.outs[0], small[0], whole)
        total = -whole.astype(np.float64)[which]
        for i in range(0, len(keys), step):
            own = slice(i, i + step)
            g, below = guess.take(which[own], axis=0), leaf[own]
            # a token's scores at all levels, as one product
            first = _firsts(below)
            true = sum(out.take(below[first] // width, axis=0) for out, width in zip(self.outs, widths, strict=True))
            total[own] += np.einsum("ij,ij->i", g, np.repeat(true, np.diff(first, append=len(below)), axis=0))
            sums = np.empty(len(g), np.float32)
            for out, width, fits in zip(self.outs[1:], widths, small[1:], strict=False):
                parent = below // width
                ends = _firsts(parent)
                for a, b, node in zip(ends.tolist(), [*ends[1:].tolist(), len(g)], (parent[ends] * self.fan).tolist(), strict=True):
                    nodes = out[node:node + self.fan]
                    _log_sums(g[a:b], nodes, fits or _small(long, nodes), sums[a:b])
                total[own] -= sums
        return total[back]


def _longest(x: np.ndarray) -> float:
    """The length of the longest vector, without the bias."""
    return math.sqrt(np.einsum("ij,ij->i", x[:, :SIZE], x[:, :SIZE]).max())


def _small(long: float, nodes: np.ndarray) -> bool:
    """Whether no score of the nodes, for guesses no longer than ``long``, may leave the range of 32-bit exponentials."""
    return long * _longest(nodes) + np.abs(nodes[:, SIZE]).max() < 80


def _log_sums(guess: np.ndarray, nodes: np.ndarray, small: bool, out: np.ndarray) -> None:
    """Log of the summed exponentials of every guess's scores of ``nodes``; if they aren't ``small``, the largest is taken off first."""
    across, ones = nodes.T, np.ones(len(nodes), np.float32)
    for i in range(0, len(guess), 1024):
        s = guess[i:i + 1024] @ across
        top = 0 if small else s.max(1)
        if not small:
            s -= top[:, None]
        own = np.matmul(np.exp(s, out=s), ones, out=out[i:i + 1024])
        np.log(own, out=own)
        own += top


def _firsts(rows: np.ndarray) -> np.ndarray:
    """Where each run of equal entries begins."""
    return np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))


def _sorted(rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``own`` and ``rows`` in order of ``rows``: numbers below 2**31, packed into one, as plain sorts are the fastest."""
    both = np.sort(rows << 32 | own)
    return both & 0xFFFFFFFF, both >> 32


def _run_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each run of rows; two columns at a time, as the parts of complex numbers."""
    n = x.shape[1]
    if n % 2:
        x = np.column_stack([x, np.zeros(len(x), x.dtype)])
    return np.add.reduceat(x.view(np.complex64), first, axis=0).view(np.float32)[:, :n]


def _step(p: np.ndarray, slow: np.ndarray, rows: np.ndarray, slopes: np.ndarray) -> None:
    """One step of Adagrad on distinct rows of ``p``."""
    own = slow.take(rows, axis=0)
    own += slopes * slopes
    slow[rows] = own
    own += np.float32(1e-8)
    np.sqrt(own, out=own)
    np.divide(slopes, own, out=own)
    own *= np.float32(RATE)
    p[rows] = own + p.take(rows, axis=0)


def _bounds(m: Model, n_tokens: float, n_blocks: int) -> list[np.ndarray]:
    """For each table of ``Model.parts()``: the first row of every bucket, and the end. A row is sent by no more tasks than
    there are blocks or tokens that train it, so buckets of frequent tokens have few rows, those of rare ones many."""
    counts = [part * n_tokens for part in m.shares]
    out = [np.array([0, len(m.places)])]
    for own in (np.append(2 * counts[2], 2 * n_blocks), *counts):
        bucket = np.cumsum(np.minimum(own, n_blocks) + 8) // BUCKET_ROWS  # so no bucket has more than 2**16 rows
        out.append(np.append(_firsts(bucket), len(own)))
    return out


_CHANGES = "part bigint, first bigint, task bigint, at binary, met binary, scale binary, body binary"
_MEANS = "part bigint, first bigint, body binary"


def _trained(start: Broadcast, n_blocks: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task = None, TaskContext.get().partitionId()
        for b in batches:
            for i in range(b.num_rows):
                words, n_words, held = (np.frombuffer(b[x][i].as_py(), t) for x, t in (("words", np.uint64), ("n_words", np.int64), ("held", bool)))
                if m is None:
                    m = Model.fresh(*start.value)
                    draw = np.random.default_rng(task)
                    slow, met = [np.full_like(p, 1e-4) for p in m.parts()], [np.zeros(len(p), np.int64) for p in m.parts()]
                c = m.classes(words)[_loose(b["tokens"][i].as_py(), int(n_words.sum()) + len(n_words))]
                train = np.repeat(~held, n_words + 1)
                if train.any():
                    m.train(m.contexts(c, n_words)[train], c[train], draw, slow, met)
        if m is None:
            return
        fresh, bounds = Model.fresh(*start.value).parts(), _bounds(m, start.value[1].sum(), n_blocks)
        for j, (p, p0, n, cut) in enumerate(zip(m.parts(), fresh, met, bounds, strict=True)):
            rows = np.flatnonzero(n)
            change = p[rows] - p0[rows]
            scale = (np.abs(change).max(1, initial=0) / 127).astype(np.float16)
            body = np.rint(np.clip(change / np.maximum(scale, np.float16(6e-8)).astype(np.float32)[:, None], -127, 127)).astype(np.int8)
            ends = np.searchsorted(rows, cut)
            for k in np.flatnonzero(np.diff(ends)):
                own = slice(ends[k], ends[k + 1])
                yield pa.record_batch({"part": pa.array([j], pa.int64()), "first": pa.array([int(cut[k])], pa.int64()), "task": pa.array([task], pa.int64()),
                                       "at": pa.array([packed((rows[own] - cut[k]).astype(np.uint16))], pa.binary()), "met": pa.array([packed(n[rows[own]].astype(np.uint32))], pa.binary()),
                                       "scale": pa.array([packed(scale[own])], pa.binary()), "body": pa.array([packed(body[own])], pa.binary())})
    return train


def _mean(t: pa.Table) -> pa.Table:
    """Averages the changes of the rows of one bucket, weighted by how often each task met them."""
    part, first = t["part"][0].as_py(), t["first"][0].as_py()
    width = SIZE if part < 2 else _WIDTH
    order = np.argsort(t["task"].to_numpy(), kind="stable")
    ats = [np.frombuffer(t["at"][i].as_py(), np.uint16) for i in order]
    size = 1 + max(int(at[-1]) for at in ats)
    total, weight = np.zeros((size, width)), np.zeros(size)
    for i, at in zip(order, ats, strict=True):
        n, scale = np.frombuffer(t["met"][i].as_py(), np.uint32), np.frombuffer(t["scale"][i].as_py(), np.float16)
        total[at] += np.frombuffer(t["body"][i].as_py(), np.int8).reshape(-1, width) * (scale.astype(np.float64) * n)[:, None]
        weight[at] += n
    return pa.table({"part": pa.array([part]), "first": pa.array([first]), "body": pa.array([packed((total / np.maximum(weight, 1)[:, None]).astype(np.float16))], pa.binary())})


_RESULT = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


_learnt: dict = {}


def _changed(start: tuple[np.ndarray, np.ndarray], means: list[tuple[int, int, bytes]]) -> Model:
    m = Model.fresh(*start)
    for part, first, body in means:
        p = m.parts()[part]
        change = np.frombuffer(body, np.float16).reshape(-1, p.shape[1])
        p[first:first + len(change)] += change
    return m


def _scored(start: Broadcast, means: Broadcast, key: str, n: int, kinds: int, n_top: int, kinds_top: int):
    outside = n - n_top + kinds - kinds_top + 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = reuse(_learnt, key, lambda: _changed(start.value, means.value))
        for b in batches:
            for i in range(b.num_rows):
                ids, known, held, n_words, words = (np.frombuffer(b[x][i].as_py(), t) for x, t in (
                    ("ids", np.int64), ("known", bool), ("held", bool), ("n_words", np.int64), ("words", np.uint64)))
                tokens = _loose(b["tokens"][i].as_py(), int(n_words.sum()) + len(n_words))
                c = np.frombuffer(b"".join(b["totals"][i].as_py()), np.int64)
                kind = m.classes(words)
                base = np.log10((c + 1) / (n + kinds + 1))
                inside = np.where(kind == 0, np.log10((c + 1) / outside), 0.0)
                at = np.cumsum(n_words + 1) - (n_words + 1)
                k = kind[tokens]
                own = m.log_probs(m.contexts(k, n_words), k) / math.log(10) + inside[tokens]
                yield pa.record_batch([pa.array(np.where(known, ids, 0), mask=~known), pa.array(held), pa.array(n_words + 1), pa.array(np.add.reduceat((c > 0)[tokens].astype(np.int64), at)),
                                       pa.array(np.full(len(ids), n)), pa.array(np.add.reduceat(base[tokens], at)), pa.array(np.add.reduceat(own, at))],
                                      names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return scored


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", classes: int | None = None, block_bytes: int = BLOCK_BYTES, min_count: int = MIN_COUNT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of each row of ``docs``;
    learnt from the rows where ``held_out`` is false. ``classes``, if given, limits the vocabulary (the most frequent stay)."""
    sc = docs.sparkSession.sparkContext
    own = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    blocks = written(own.mapInArrow(_pack(block_bytes), _BLOCKS), "lm-blocks", "zstd")
    n_blocks, n_distinct = blocks.agg(F.count("*"), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    n_buckets = power_of_two(n_distinct / BUCKET_WORDS)
    sent = blocks.select("block", "words", "counts").mapInArrow(_send(n_buckets), "block bigint, bucket bigint, words binary, counts binary")
    replies = written(sent.groupBy("bucket").applyInArrow(_add_up(min_count), "block bigint, bucket bigint, reply binary, top binary, top_n binary, n bigint, kinds bigint"), "lm-counts", "zstd")
    n, kinds = replies.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    top = replies.where("top is not null").select("top", "top_n").toArrow()
    words, counts = (np.frombuffer(b"".join(top[x].to_pylist()), t) for x, t in (("top", np.uint64), ("top_n", np.int64)))
    most = np.lexsort((words, -counts))[:None if classes is None else classes - 1]
    order = most[np.argsort(words[most])]
    words, counts = words[order], counts[order].astype(np.float64)
    share = np.concatenate(([n - counts.sum() + 1], counts))
    start = sc.broadcast((words, share))
    trained = blocks.select("words", "n_words", "held", "tokens").mapInArrow(_trained(start, n_blocks), _CHANGES)
    mean = trained.groupBy("part", "first").applyInArrow(_mean, _MEANS).toArrow()
    means = sc.broadcast(list(zip(*(mean[x].to_pylist() for x in ("part", "first", "body")), strict=True)))
    totals = answers(replies, "totals")
    return blocks.drop("counts", "n_distinct").join(totals, "block").mapInArrow(_scored(start, means, uuid.uuid4().hex, int(n), int(kinds), int(counts.sum()), len(words)), _RESULT)
