"""Benchmark decontamination: one Aho-Corasick automaton over the test items, documents scanned once.

Words are turned into small numbers (their place in the items' vocabulary), so that a window of words is a short
string over that vocabulary and all windows form one automaton. A word outside the vocabulary always leads back to
the automaton's root, hence only runs of known words are fed to it. Hits are mapped back to word and character
offsets of the original text.

Scale: a narrow transformation, no shuffle. The items are collected and broadcast in blocks of at most
``block_bytes`` of text; further blocks take one more pass each over documents written in between, and hits of all
passes are merged, so that the items may have any size.

Defined cases: a null or empty text has no words and no hits; items without words never occur; an item with a null
item_id marks words as hit but is not listed; items of equal text are all listed; repeated rows are judged each on
its own; an empty benchmark hits nothing. All input columns are kept; the result column is ``hits``, which replaces
a column of that name.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm._text import ALNUM, chunks, reuse, written

WINDOW = 13
#: Most bytes of item text held by one automaton, and broadcast at once.
BLOCK_BYTES = 8 << 20

HITS = "struct<n_words:bigint,spans:array<struct<w0:bigint,w1:bigint,c0:bigint,c1:bigint>>,items:array<string>>"
_SPAN = pa.struct([(x, pa.int64()) for x in ("w0", "w1", "c0", "c1")])
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])
_UNKNOWN = 1
_built: dict = {}


class Windows:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        hashes = [np.zeros(0, dtype=np.uint64)] * len(items)
        for c in chunks(pa.array([t for _, t in items], pa.string()), ALNUM):
            h = c.hashes()
            for d in range(c.n):
                hashes[c.first + d] = h[c.ptr[d]:c.ptr[d + 1]]
        self.words = np.unique(np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)]))
        owners: dict[str, set[str]] = {}
        for (item, _), h in zip(items, hashes, strict=True):
            s, k = self.spell(h), min(window, len(h))
            for i in range(len(s) - k + 1 if k else 0):
                owners.setdefault(s[i:i + k], set()).update([item] if item is not None else [])
        self.shortest = min(map(len, owners), default=0)
        self.automaton = ahocorasick.Automaton()
        for s, who in owners.items():
            self.automaton.add_word(s, (len(s), who))
        if owners:
            self.automaton.make_automaton()

    def codes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), _UNKNOWN, dtype=np.uint32)
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        code = np.where(i + 2 < 0xD800, i + 2, i + 2 + 0x800)  # leaves out the surrogates
        return np.where(self.words[i] == h, code, _UNKNOWN).astype(np.uint32)

    def spell(self, h: np.ndarray) -> str:
        return self.codes(h).tobytes().decode("utf-32-le")

    def scan(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [first, end) word ranges that windows cover, and the items whose windows occur."""
        if not self.shortest or len(codes) < self.shortest:
            return [], set()
        known = np.concatenate(([False], codes != _UNKNOWN, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        found: list[list[int]] = []
        items: set[str] = set()
        for a, b in zip(edges[0::2], edges[1::2], strict=True):
            if b - a < self.shortest:
                continue
            for end, (k, who) in self.automaton.iter(codes[a:b].tobytes().decode("utf-32-le")):
                first, last = int(a) + end - k + 1, int(a) + end + 1
                items |= who
                while found and found[-1][0] >= first:
                    found.pop()
                if found and found[-1][1] >= first:
                    found[-1][1] = max(found[-1][1], last)
                else:
                    found.append([first, last])
        return [(x, y) for x, y in found], items


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["w0"], -s["w1"])):
        if out and s["w0"] <= out[-1]["w1"]:
            if s["w1"] > out[-1]["w1"]:
                out[-1] |= {"w1": s["w1"], "c1": s["c1"]}
        else:
            out.append(dict(s))
    return out


def _scanner(items, window: int, before: bool):
    key = uuid.uuid4().hex

    def scan(texts: pa.Array, earlier: pa.Array | None = None) -> pa.Array:
        found = reuse(_built, key, lambda: Windows(items.value, window))
        was, out = earlier.to_pylist() if before else None, []
        for c in chunks(texts, ALNUM):
            codes = found.codes(c.hashes())
            for d in range(c.n):
                own = codes[c.ptr[d]:c.ptr[d + 1]]
                spans, who = found.scan(own)
                rows = []
                if spans:
                    w = np.array(spans) + c.ptr[d]
                    c0, c1 = c.chars(d, c.start[w[:, 0]]), c.chars(d, c.end[w[:, 1] - 1])
                    rows = [{"w0": a, "w1": b, "c0": int(x), "c1": int(y)} for (a, b), x, y in zip(spans, c0, c1, strict=True)]
                if was and (old := was[c.first + d]):
                    rows, who = _merged(rows + old["spans"]), who | set(old["items"])
                out.append({"n_words": len(own), "spans": rows, "items": sorted(who)})
        return pa.array(out, _ARROW)

    if before:
        def again(texts: pa.Array, earlier: pa.Array) -> pa.Array:
            return scan(texts, earlier)
        return F.arrow_udf(again, HITS)

    def once(texts: pa.Array) -> pa.Array:
        return scan(texts)
    return F.arrow_udf(once, HITS)


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``hits``: n_words, merged hit spans (words and characters, end exclusive) and the items found."""
    own = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    size = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks))
    out = docs
    for b in range(n_blocks):
        part = [(r["i"], r["t"]) for r in (own.where(block == b) if n_blocks > 1 else own).collect()]
        sent = docs.sparkSession.sparkContext.broadcast(part)
        cols = [F.col(text)] if b == 0 else [F.col(text), F.col("hits")]
        out = out.withColumn("hits", _scanner(sent, window, b > 0)(*cols))
        if b < n_blocks - 1:
            out = written(out, "decontaminate")
    return out


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(f"{hits}.spans", F.lit(0).cast("bigint"), lambda n, s: n + s["w1"] - s["w0"])


def contaminated(hits: str = "hits") -> Column:
    """At least one word in twenty is hit."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))
