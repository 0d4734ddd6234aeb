"""Quality classifier: Bradley-Terry pairwise ranking.

Preference pairs (a document marked good, one marked bad) train a linear score by the logistic loss on differences of
features, P(good beats bad) = sigmoid(w . (x_good - x_bad)). The cut is a score quantile: the share of bad documents
among the training labels, taken over the scores of all labelled documents, however many the weights are fitted on. The reported score is sigmoid((w . x - cut) / spread + logit(threshold)), so that a
document reaches ``threshold`` exactly if its ranking score reaches that quantile.

Features come from the whole text alone: shares of byte classes, word shape, repeated words and lines.

Scale: scoring is a narrow Arrow transformation. For training, the features of all documents (not their texts) meet the
labels, and the labelled ones are written once. Weights are fitted on a bounded sample of them (``max_labelled`` of each
class, smallest hash of the id first); cut and spread come from distributed aggregates over all of them. The model is
some dozens of numbers in the closure.

Defined cases: null text is empty; empty texts get a score from their features like any other; null labels and labels
without a document are left out; repeated label rows count as often as they occur; with no good or no bad label
every document gets score 1.0 (nothing is rejected). All input columns are kept; the added column is ``score``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm._text import NON_SPACE, chunks, ranges, shuffled, written
from tabsight.operators.ordered import exact_quantiles

THRESHOLD = 0.3
#: Labelled rows of each class that the weights are fitted on, at most; the cut is taken over all.
MAX_LABELLED = 4000
#: Preference pairs: partners drawn for each labelled row.
PARTNERS = 8

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".,;:", "!?", "|", "#$%&*@^~<>{}[]\\/=+_", "\"'()-`"]
_OF = np.full(256, len(_CLASSES), dtype=np.int64)  # other bytes: parts of non-ASCII characters
for _i, _c in enumerate(_CLASSES):
    _OF[list(_c.encode())] = _i
_N = len(_CLASSES) + 1


def features(texts: pa.Array) -> np.ndarray:
    """One row of features per text."""
    out = []
    for c in chunks(texts, NON_SPACE):
        lens, words = c.till - c.at, np.diff(c.ptr)
        owner = np.repeat(np.arange(c.n), lens)
        where = ranges(lens) + np.repeat(c.at, lens)
        share = np.bincount(owner * _N + _OF[c.raw[where]], minlength=c.n * _N).reshape(c.n, _N) / np.maximum(lens, 1)[:, None]
        h, doc = c.hashes(), np.repeat(np.arange(c.n), words)
        distinct = _distinct(h, doc, c.n) / np.maximum(words, 1)
        twice = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=c.n) / np.maximum(words, 1)
        # a line is the run of words before a line break: lines are compared by the sum of their words' fingerprints
        breaks = np.concatenate(([0], np.cumsum(c.buf == 0x0A)))[c.start]
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (breaks[1:] != breaks[:-1])))[:len(h)]
        line = np.flatnonzero(new)
        lines = np.bincount(doc[line], minlength=c.n)
        kinds = _distinct(np.add.reduceat(h, line) if len(line) else h, doc[line], c.n)
        size = np.bincount(doc, c.end - c.start, minlength=c.n) / np.maximum(words, 1)
        # digits right behind letters, and so on: changes of class inside words
        fine = np.column_stack([share, np.sqrt(share), distinct, twice, np.sqrt(twice), 1 - kinds / np.maximum(lines, 1),
                                np.minimum(size, 40) / 10, np.log1p(words), (words == 0)])
        out.append(fine)
    return np.concatenate(out) if out else np.zeros((0, 2 * _N + 7))


def _distinct(value: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    first = np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))[:len(v)]
    return np.bincount(o[first], minlength=n)


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray, threshold: float) -> np.ndarray:
        z = (self.raw(x) - self.cut) / self.spread + math.log(threshold / (1 - threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, partners: int = PARTNERS, ridge: float = 1e-3, steps: int = 25) -> Ranker:
    """Newton steps on the mean logistic loss of feature differences, with a small quadratic penalty. Cut and spread are
    those of the rows given."""
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    g, b = (np.clip((x - mean) / scale, -8, 8) for x in (good, bad))
    # every row meets ``partners`` rows of the other class, dealt evenly
    n = max(len(g), len(b)) * partners
    i = np.arange(n)
    diff = g[i % len(g)] - b[(i * 7919 + i // len(g)) % len(b)]
    w = np.zeros(diff.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # that the pair is ranked wrongly
        slope = -(diff.T @ p) / n + ridge * w
        bend = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    rank = np.concatenate([g @ w, b @ w])
    cut = float(np.quantile(rank, len(b) / len(rank)))
    return Ranker(mean, scale, w, cut, float(max(rank.std(), 1e-6)) / 4)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
        max_labelled: int = MAX_LABELLED) -> Ranker | None:
    """Learns from the labels where ``keep`` holds (a condition on the id). None without labels of both classes."""
    own = labels.where(keep & F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y"))
    x = F.arrow_udf(_vectors, "array<double>")
    labelled = written(docs.select(F.col(doc_id).alias("i"), x(F.col(text)).alias("x")).join(shuffled(own), "i"), "quality-labelled")
    n = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    sample = {}
    for y in (1, 0):
        # at most max_labelled ids: small by construction
        ids = labelled.where(F.col("y") == y).select("i").orderBy(F.xxhash64("i"), "i").limit(max_labelled).distinct()
        rows = labelled.where(F.col("y") == y).join(F.broadcast(ids), "i").orderBy("i", "x").limit(max_labelled).collect()
        sample[y] = np.array([r["x"] for r in rows])
    model = fit_pairs(sample[1], sample[0])

    def rank(v: pa.Array) -> pa.Array:
        return pa.array(model.raw(v.flatten().to_numpy().reshape(len(v), -1)) if len(v) else [], pa.float64())
    ranks = labelled.select(F.arrow_udf(rank, "double")(F.col("x")).alias("r"))
    spread = ranks.agg(F.stddev_pop("r")).first()[0]
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = exact_quantiles(ranks, [], "r", [n[0] / (n[0] + n[1])], buckets).first()["q"]
    return replace(model, cut=float(cut), spread=float(max(spread, 1e-6)) / 4)


def _vectors(t: pa.Array) -> pa.Array:
    return pa.array(list(features(t)), pa.list_(pa.float64()))


def score(docs: DataFrame, model: Ranker | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, at least ``threshold`` from the cut upwards)."""
    if model is None:
        return docs.withColumn("score", F.lit(1.0))

    def scored(t: pa.Array) -> pa.Array:
        return pa.array(model.score(features(t), threshold), pa.float64())
    return docs.withColumn("score", F.arrow_udf(scored, "double")(F.col(text)))
