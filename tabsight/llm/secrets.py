"""Secret scans: formats of credentials inferred as probabilistic automata.

Credentials that fixed patterns find in the documents serve as labelled examples of their kind. For each kind a
prefix tree of the examples (over classes of characters) is generalised: states whose outgoing and stopping
frequencies are statistically compatible, all the way down, are merged (Hoeffding bound), which leaves a
probabilistic automaton of the format. Every other token of the documents that mixes letters and digits is a candidate
and is scored by its mean log-probability per character; one that is as likely as nearly all examples of a kind, and
nearly as long as the shortest, becomes a span of kind ``format``. Spans of the fixed patterns always stay.

Scale: scanning is a narrow Arrow transformation without shuffle. Fitting reads a bounded set of examples
(``max_labelled`` of each kind, smallest hash first, found in a pass over all documents); the automata are small.

Defined cases: a null text is empty; without examples of a kind there is no automaton of it; repeated rows are
judged each on its own; very long texts are scanned whole. All input columns are kept; the added column is
``secrets`` (spans in code points, end exclusive), which replaces a column of that name.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm._text import Chunk, chunks

#: Examples of each kind that an automaton is fitted on, at most.
MAX_LABELLED = 500
#: With fewer examples of a kind there is no automaton of it.
MIN_LABELLED = 8
MIN_CANDIDATE = 16
KINDS = ("assign", "access", "hex", "format")

_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode())] = True
    return table


_DIGIT, _LOWER_HEX = "0123456789", "abcdef"
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IS_HEX, _IS_SIGN = _bytes(_DIGIT + _LOWER_HEX), _bytes(":=")
_IS_DIGIT, _IS_LETTER = _bytes(_DIGIT), _bytes(_LOW + _UP)
_IS_TOKEN = _bytes(_DIGIT + _LOW + _UP + "+/_=-")

#: Classes of characters that the automata read: name and members; any other character is a class of its own.
_SYMBOLS = {"9": _DIGIT, "f": _LOWER_HEX, "z": _LOW[6:], "F": _UP[:6], "Z": _UP[6:]}
_CLASS = {c: s for s, members in _SYMBOLS.items() for c in members}
_LOG_SIZE = {s: math.log(len(m)) for s, m in _SYMBOLS.items()}


def _runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    a, b = edges[0::2], edges[1::2]
    keep = b - a >= least
    return list(zip(a[keep].tolist(), b[keep].tolist(), strict=True))


def base_spans(c: Chunk) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) in bytes of ``c.raw``: what the fixed patterns find, in no order."""
    data = c.raw.tobytes()
    out = [(a, b, "hex", data[a:b].decode()) for a, b in _runs(_IS_HEX[c.raw], 32)]
    out += [(m.start(), m.end(), "access", m[0].decode()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 16]
    signs = np.flatnonzero(_IS_SIGN[c.raw])
    for d in np.unique(np.searchsorted(c.at, signs, "right") - 1).tolist() if len(signs) else []:
        out += [(m.start(), m.end(), "assign", m[1].decode()) for m in _ASSIGN.finditer(data, int(c.at[d]), int(c.till[d])) if len(m[1]) >= 8]
    return out


class FormatAutomaton:
    """A probabilistic automaton learnt from strings; ``mean_log`` is a string's log-probability per character."""

    def __init__(self, examples: list[str], alpha: float = 0.02):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.stop, self.seen = [0], [0]
        for e in examples:
            self._add([_CLASS.get(ch, ch) for ch in e])
        self._generalise()
        scores = sorted(map(self.mean_log, examples))
        self.least_score = scores[len(scores) // 100] - 1e-9
        self.least_len = max(MIN_CANDIDATE, math.ceil(0.75 * min(map(len, examples))))

    def _add(self, symbols: list[str]) -> None:
        s = 0
        for x in symbols:
            self.seen[s] += 1
            self.count[s][x] = self.count[s].get(x, 0) + 1
            if x not in self.next[s]:
                self.next[s][x] = len(self.next)
                self.next.append({})
                self.count.append({})
                self.stop.append(0)
                self.seen.append(0)
            s = self.next[s][x]
        self.seen[s] += 1
        self.stop[s] += 1

    def _close(self, f: int, n: int, g: int, m: int) -> bool:
        return not n or not m or abs(f / n - g / m) < self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if not self._close(self.stop[a], n, self.stop[b], m):
                return False
            for x in self.count[a].keys() | self.count[b].keys():
                if not self._close(self.count[a].get(x, 0), n, self.count[b].get(x, 0), m):
                    return False
                if x in self.next[a] and x in self.next[b]:
                    todo.append((self.next[a][x], self.next[b][x]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below ``b`` to the automaton at ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.stop[a] += self.stop[b]
            for x, n in self.count[b].items():
                self.count[a][x] = self.count[a].get(x, 0) + n
                if x in self.next[a]:
                    todo.append((self.next[a][x], self.next[b][x]))
                else:
                    self.next[a][x] = self.next[b][x]

    def _generalise(self) -> None:
        settled = [0]
        while True:
            edge = next(((s, x, t) for s in settled for x, t in sorted(self.next[s].items()) if t not in settled), None)
            if edge is None:
                return
            s, x, t = edge
            into = next((r for r in settled if self._compatible(r, t)), None)
            if into is None:
                settled.append(t)
            else:
                self.next[s][x] = into
                self._fold(into, t)

    def mean_log(self, text: str) -> float:
        s, total = 0, 0.0
        for ch in text:
            x = _CLASS.get(ch, ch)
            total += math.log((self.count[s].get(x, 0) + 1e-3) / (self.seen[s] + 1e-1)) - _LOG_SIZE.get(x, 0.0)
            s = self.next[s].get(x, 0)
        return total / max(1, len(text))

    def accepts(self, text: str) -> bool:
        return len(text) >= self.least_len and self.mean_log(text) >= self.least_score


SECRETS = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,spans:array<struct<start:bigint,kind:string,end:bigint>>>"
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
_ARROW = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("spans", pa.list_(_SPAN))])


def _examples(texts: pa.Array) -> pa.Array:
    out: list[list[dict]] = []
    for c in chunks(texts):
        rows: list[list[dict]] = [[] for _ in range(c.n)]
        for a, _, kind, value in base_spans(c):
            rows[int(np.searchsorted(c.at, a, "right")) - 1].append({"kind": kind, "value": value})
        out += rows
    return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))


def fit(docs: DataFrame, text: str = "text", max_labelled: int = MAX_LABELLED) -> list[FormatAutomaton]:
    """Automata of the kinds that the documents hold enough examples of."""
    found = F.arrow_udf(_examples, "array<struct<kind:string,value:string>>")
    own = docs.select(F.explode(found(F.col(text))).alias("x")).select("x.kind", "x.value").where(F.length("value") <= 512).distinct()
    # at most max_labelled strings of a bounded kind each, cut in every task first; no value is written to a table
    first = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    labelled = own.withColumn("n", F.row_number().over(first)).where(F.col("n") <= max_labelled).select("kind", "value").collect()
    out = []
    for kind in KINDS[:3]:
        rows = [r for r in labelled if r["kind"] == kind]
        if len(rows) >= MIN_LABELLED:
            out.append(FormatAutomaton(sorted(r["value"] for r in rows)))
    return out


def find_secrets(docs: DataFrame, automata: list[FormatAutomaton], text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``: counts of base spans and all spans by start, then kind."""
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for c in chunks(texts):
            base = base_spans(c)
            rows: list[list[tuple[int, int, str]]] = [[] for _ in range(c.n)]
            for a, b, kind, _ in base:
                rows[int(np.searchsorted(c.at, a, "right")) - 1].append((a, b, kind))
            for a, b in _runs(_IS_TOKEN[c.raw], MIN_CANDIDATE) if automata else []:
                if not (_IS_DIGIT[c.raw[a:b]].any() and _IS_LETTER[c.raw[a:b]].any()):
                    continue
                own = rows[int(np.searchsorted(c.at, a, "right")) - 1]
                value = c.raw[a:b].tobytes().decode()
                if not any(x < b and a < y for x, y, _ in own) and any(m.accepts(value) for m in automata):
                    own.append((a, b, "format"))
            for d, own in enumerate(rows):
                spans = []
                if own:
                    ends = c.chars(d, np.array([x[:2] for x in own]).reshape(-1)).reshape(-1, 2).tolist()
                    spans = sorted((s, KINDS.index(k), e) for (s, e), (_, _, k) in zip(ends, own, strict=True))
                n = [sum(k == i for _, k, _ in spans) for i in range(3)]
                out.append({"n_assign": n[0], "n_access": n[1], "n_hex": n[2], "spans": [{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans]})
        return pa.array(out, _ARROW)
    return docs.withColumn("secrets", F.arrow_udf(scan, SECRETS)(F.col(text)))


def listed(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of spans of these kinds, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text, spans, mark: str = "[secret]"):
    """``text`` with every span replaced by ``mark``; overlapping spans are replaced as one. A null text stays null."""
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            parts, at = [], 0
            for x in s or [] if t is not None else []:
                if x["start"] >= at:
                    parts += [t[at:x["start"]], mark]
                at = max(at, x["end"])
            out.append("".join([*parts, t[at:]]) if parts else t)
        return pa.array(out, pa.string())
    return F.arrow_udf(cut, "string")(text, spans)
