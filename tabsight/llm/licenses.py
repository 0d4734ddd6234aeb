"""License scans: template markup compiled to token automata.

A template is a text with markup: ``[[ ... ]]`` is an optional region, ``{{n}}`` a replaceable region of 0 to n words.
All other wording is mandatory and must match exactly, word for word. Each template becomes an automaton over words
whose states are positions in the template; it is run from every word that can begin a template. Beside the labels
of templates there are fixed base phrases.

Scale: a narrow Arrow transformation without shuffle; the templates are a fixed set in the code.

Defined cases: a null text is empty; empty texts have no words and no labels (score 0); repeated rows are judged each
on its own; very long texts are scanned whole. All input columns are kept; the added column is ``license``, which
replaces a column of that name. The score is 0 without a label, 0.6 with base phrases alone, 0.4 or less with
template labels alone and up to 1 with both.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsight.llm._text import ALNUM, chunks

#: Fixed by the contract: phrase and label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label and template; a label may have several.
TEMPLATES = (
    ("notice-cc-by", "[[this work is]] licensed under [[a]] [[the]] [[creative commons]] cc by {{4}}"),
    ("notice-cc-by", "licensed under [[a]] [[the]] creative commons attribution {{4}} license"),
    ("notice-gpl", "[[this work is]] licensed under the [[gnu]] [[lesser]] [[affero]] general public license [[version {{3}}]]"),
    ("notice-gpl", "under the terms of the [[gnu]] [[lesser]] [[affero]] general public license {{24}}"),
    ("notice-mit", "released under the mit license"),
    ("notice-mit", "licensed under the mit license"),
    ("notice-mit", "permission is hereby granted free of charge to any person obtaining a copy of {{8}} and associated documentation files"),
    ("notice-apache", "licensed under the apache license version {{2}}"),
    ("notice-bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("notice-reserved", "copyright [[c]] {{8}} all rights reserved"),
)

LICENSE = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:array<string>,labels:array<string>,spans:array<struct<label:string,w0:bigint,w1:bigint>>,score:double>"
_SPAN = pa.struct([("label", pa.string()), ("w0", pa.int64()), ("w1", pa.int64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("spans", pa.list_(_SPAN)), ("score", pa.float64())])

_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\s\[\]{}]+")
ANY = None  # a transition on any word


class Automaton:
    """States are numbers; ``moves[s]`` lists (word or ANY, next state), ``skips[s]`` the states reached for nothing."""

    def __init__(self, markup: str):
        self.moves: list[list[tuple[str | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        opened: list[int] = []
        last = 0
        for m in _MARK.finditer(markup):
            if m[0] == "[[":
                opened.append(last)
            elif m[0] == "]]":
                end = self._state()
                self.skips[last].append(end)
                self.skips[opened.pop()].append(end)
                last = end
            elif m[1]:
                end = self._state()
                for _ in range(int(m[1])):
                    self.skips[last].append(end)
                    nxt = self._state()
                    self.moves[last].append((ANY, nxt))
                    last = nxt
                self.skips[last].append(end)
                last = end
            else:
                nxt = self._state()
                self.moves[last].append((m[0], nxt))
                last = nxt
        self.final = last
        self.start = self._closed({0})
        self.first = {w for s in self.start for w, _ in self.moves[s]}
        if ANY in self.first or self.final in self.start:
            raise ValueError("a template must begin with mandatory or optional wording and hold a mandatory word")

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for n in self.skips[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def match(self, words: Sequence[str], at: int) -> int | None:
        """End of the shortest accepted run of words that starts at ``at``."""
        now = self.start
        for i in range(at, len(words)):
            now = self._closed({n for s in now for w, n in self.moves[s] if w is ANY or w == words[i]})
            if not now:
                return None
            if self.final in now:
                return i + 1
        return None


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(tuple(p.split()), label) for p, label in phrases]
        self.automata = [(label, Automaton(t)) for label, t in templates]
        starts = {p[0] for p, _ in self.phrases} | {w for _, a in self.automata for w in a.first}
        self.hashes = {w: _hash(w) for w in starts}
        self.wanted = np.array(sorted(self.hashes.values()), dtype=np.uint64)

    def scan(self, words: Sequence[str], starts) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(label, first word, end) of base phrases and of templates that begin at one of ``starts``."""
        base, more = [], []
        for i in starts:
            base += [(label, i, i + len(p)) for p, label in self.phrases if tuple(words[i:i + len(p)]) == p]
            more += [(label, i, end) for label, a in self.automata if words[i] in a.first and (end := a.match(words, i)) is not None]
        return base, more


def _hash(word: str) -> int:
    return int(next(chunks(pa.array([word]), ALNUM)).hashes()[0])


class _Words(Sequence):
    """Words of one document of a chunk, decoded when asked for."""

    def __init__(self, c, d):
        self.c, self.a, self.b = c, int(c.ptr[d]), int(c.ptr[d + 1])

    def __len__(self):
        return self.b - self.a

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[j] for j in range(*i.indices(len(self)))]
        return self.c.buf[self.c.start[self.a + i]:self.c.end[self.a + i]].tobytes().decode()


def find_licenses(docs: DataFrame, text: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``docs`` with ``license``: word count, places of base phrases, labels, spans (in words) and a score."""
    scanner = Scanner(phrases, templates)

    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for c in chunks(texts, ALNUM):
            h = c.hashes()
            i = np.minimum(np.searchsorted(scanner.wanted, h), len(scanner.wanted) - 1)
            can = np.flatnonzero(scanner.wanted[i] == h)
            cut = np.searchsorted(can, c.ptr)
            for d in range(c.n):
                base, more = scanner.scan(_Words(c, d), (can[cut[d]:cut[d + 1]] - c.ptr[d]).tolist())
                at, labels = [b[1] for b in base], sorted({x[0] for x in base + more})
                out.append({"n_words": int(c.ptr[d + 1] - c.ptr[d]), "n_base": len(base), "first_word": min(at, default=None), "last_word": max(at, default=None),
                            "base_labels": sorted({b[0] for b in base}), "labels": labels, "spans": [dict(zip(("label", "w0", "w1"), x, strict=True)) for x in base + more],
                            "score": 0.6 * bool(base) + 0.4 * min(1.0, len({x[0] for x in more}))})
        return pa.array(out, _ARROW)
    return docs.withColumn("license", F.arrow_udf(scan, LICENSE)(F.col(text)))
