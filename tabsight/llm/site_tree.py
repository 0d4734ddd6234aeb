"""HTML extraction by a site style tree.

Every page's DOM is merged into a tree of its host. An element node of that tree stands for a path of tags and class
names; it counts, over the host's pages, how the element is presented (the sequence of its children) and what it holds
(its text). A node whose text differs from page to page is important, one that repeats is not:

* content = 1 - sum over texts of c/m * min(1, log c / log ``BASE``): m pages of the host have the node, c of them
  with this text. It is an entropy that counts a text as worthless once it stands on ``BASE`` pages.
* presentation: the same over child sequences; for nodes whose role the markup names it is fixed at 0 (menus, footers,
  sidebars, notices, adverts, forms, comments) or 1 (``article``, ``main``).
* importance = ``ROLE_WEIGHT`` * presentation + rest * content where the role is named, else ``STYLE_WEIGHT`` *
  presentation + rest * content; a host's values are drawn towards those of the tree of all hosts by ``PRIOR`` pages,
  so that a host of few pages is judged by what its elements are elsewhere.

Branches of an importance below ``THRESHOLD`` go from each page, but never an element that holds the article itself, nor one
without a named role that holds half of the page's text. If a page marks articles (else a main part), text outside them goes too. Scripts, styles, head and form controls never
count as text. What is left is cut into blocks at the borders of block elements.

Scale: pages are parsed twice in tasks (no page is shuffled); only (host, path, text hash) counts are, summed on the map
side, so a host with a third of all pages is many partial sums. The table of branches to remove is sent to the tasks if it
has at most ``broadcast_limit`` rows, else joined by host, hosts split over many keys by their page count.

Defined cases: a null or empty html, or one without text, gives an empty text; a null url, or one without ``://``, has the
empty host; unclosed, misnested and cut-off markup is read as far as it goes (a tag that never closes is left out); repeated
pages stay repeated; an empty table gives an empty table. Input columns are kept; ``text`` and ``n_chars`` are added and
replace columns of these names.
"""

from __future__ import annotations

import math
import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm._text import written
from tabsight.llm.urls import host_and_path

THRESHOLD = 0.5
ROLE_WEIGHT = 0.6
STYLE_WEIGHT = 0.1
#: A text on so many pages of a host says nothing about one of them.
BASE = 8
#: Pages of the tree of all hosts that count beside a host's own.
PRIOR = 50
#: Rows of the removal table (16 bytes each) that are sent to all tasks.
BROADCAST_LIMIT = 500_000

# fixed values: elements of HTML by how they are read
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_HIDDEN = frozenset("noscript template svg select button object canvas audio video datalist head".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINER = frozenset("article main section div center nav header footer aside form menu dialog ul ol dl table figure details fieldset address".split())
_BLOCK = _CONTAINER | _HEADING | frozenset("html body p li dt dd thead tbody tfoot tr td th caption pre blockquote figcaption summary legend hgroup search".split())
_CLOSES_P = (_CONTAINER | _HEADING | frozenset("p pre blockquote hr li dd dt".split())) - {"table"}
_HEAD_ONLY = frozenset("base link meta script style title noscript template".split())
#: Closed by an element of the same group that starts, and what stops the search.
_SIBLINGS = {x: g for g in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("thead", "tbody", "tfoot")) for x in g}
_STOPS = frozenset("html body ul ol dl table article main section nav aside header footer form".split())

# fixed values: names that say what an element is for
_NOISE_TAGS = frozenset("nav header footer aside form menu dialog search".split())
_NAMED = _NOISE_TAGS | {"article", "main"}
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NOISE_NAMES = frozenset("""
    ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead toolbar pagination pager skip
    cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login
    share sharing social related recommended widget
    comment comments disqus respond reply replies""".split())
_ASIDE_NAMES = frozenset("comment comments disqus respond reply replies related recommended".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|</?[A-Za-z][^<>]*\Z""", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in _RAW}
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_DIGITS = re.compile(r"\d+")
_MOD, _FACTOR = (1 << 61) - 1, 0x9E3779B97F4A7C1


_hashes: dict = {}


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _path(up: int, own) -> int:
    """Hash of an element's path; paths repeat, so they are remembered (within a bound)."""
    key = (up, own)
    if key not in _hashes:
        if len(_hashes) > 100_000:
            _hashes.clear()
        _hashes[key] = _hash(f"{up} {own}")
    return _hashes[key]


class Page:
    """The block elements of a page (``parent``, ``tag``, ``path``, ``role``) and its blocks of text with their element."""

    def __init__(self, html: str):
        self.parent, self.tag, self.role, self.label, self.children = [-1], ["html"], [0], ["html"], [[]]
        self.aside = [False]
        self.first, self.last = [0], [0]
        self.texts: list[str] = []
        self.at: list[int] = []
        self._stack, self._open, self._buffer, self._hidden = [0], {"html": 1}, [], 0
        self._read(html)
        while len(self._stack) > 1:
            self._pop()
        self._flush()
        self.last[0] = len(self.texts)
        self._landmarks()

    # reading

    def _read(self, html: str) -> None:
        pos, buffer = 0, self._buffer
        while m := _TOKEN.search(html, pos):
            if m.start() > pos and not self._hidden:
                buffer.append(html[pos:m.start()])
            pos = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
            elif name in _RAW:
                end = _RAW_END[name].search(html, pos)
                pos = end.end() if end else len(html)
            else:
                self._start(name, m[3])
        if not self._hidden:
            buffer.append(html[pos:])

    def _start(self, name: str, attributes: str) -> None:
        if name in _VOID:
            if name == "br":
                self._buffer.append(" ")
            elif name == "hr":
                self._close_p()
            return
        if "head" in self._open and name not in _HEAD_ONLY:
            self._pop_to("head")
        if name in _HIDDEN:
            if not attributes.rstrip().endswith("/"):
                self._push(name, "")
            return
        if name not in _BLOCK or name in ("html", "body") and name in self._open:
            return
        if name in _CLOSES_P:
            self._close_p()
        if name in _SIBLINGS:
            self._close_sibling(_SIBLINGS[name])
        elif name in _HEADING and self.tag[self._stack[-1]] in _HEADING:
            self._pop()
        self._push(name, attributes)

    def _end(self, name: str) -> None:
        if name == "br":
            self._buffer.append(" ")
        elif name in self._open and name not in ("html", "body"):
            self._pop_to(name)
        elif name in _BLOCK:
            self._flush()

    def _close_p(self) -> None:
        self._flush()
        if "p" in self._open:
            self._pop_to("p")

    def _close_sibling(self, group: tuple[str, ...]) -> None:
        if not any(g in self._open for g in group):
            return
        for i in reversed(self._stack):
            if self.tag[i] in group:
                self._pop_to(self.tag[i])
                return
            if self.tag[i] in _STOPS:
                return

    def _push(self, name: str, attributes: str) -> None:
        if name in _HIDDEN:
            self._hidden += 1
        else:
            self._flush()
        up = self._stack[-1]
        label, role, aside = name, 0, self.aside[up]
        if attributes or name in _NAMED:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
            role, aside = self._role_of(name, found, up)
            if found:
                names = [_DIGITS.sub("0", x) for x in found.get("class", "").split()]
                label = " ".join([name, *sorted(names), "#" + _DIGITS.sub("0", found["id"])] if "id" in found else [name, *sorted(names)])
        self.children[up].append(name)
        self._stack.append(len(self.tag))
        self.parent.append(up)
        self.tag.append(name)
        self.role.append(role)
        self.aside.append(aside)
        self.children.append([])
        self.first.append(len(self.texts))
        self.last.append(0)
        self.label.append(label)
        self._open[name] = self._open.get(name, 0) + 1

    def _pop(self) -> None:
        i = self._stack[-1]
        name = self.tag[i]
        if name in _HIDDEN:
            self._hidden -= 1
        else:
            self._flush()
        self._stack.pop()
        self.last[i] = len(self.texts)
        self._open[name] -= 1
        if not self._open[name]:
            del self._open[name]

    def _pop_to(self, name: str) -> None:
        while self.tag[self._stack[-1]] != name:
            self._pop()
        self._pop()

    def _flush(self) -> None:
        if self._buffer:
            text = "".join(self._buffer)
            self._buffer.clear()
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                self.texts.append(text)
                self.at.append(self._stack[-1])

    # roles

    def _role_of(self, tag: str, found: dict[str, str], up: int) -> tuple[int, bool]:
        """1: the article or main part, -1: named as something else, 0: not named; whether articles inside don't count."""
        names = {x.lower() for a in ("class", "id") if a in found for x in _NAME_PARTS.findall(found[a])}
        aria, inside = found.get("role", "").lower(), self.aside[up]
        whole = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
        aside = inside or tag in ("nav", "footer", "aside") or tag not in ("body", "main") and (bool(names & _ASIDE_NAMES) or "sidebar" in whole)
        if tag in ("article", "main") or aria in ("article", "main"):
            if not aside:
                return 1, False
            return -1 if names & _NOISE_NAMES else 0, True
        if tag in _NOISE_TAGS and not (tag == "header" and self._in_article(up)) or aria in _NOISE_ROLES:
            return -1, aside
        if names & _NOISE_NAMES and tag in _BLOCK and tag not in _HEADING and tag != "body" and not (names & _NOISE_NAMES == {"header"} and self._in_article(up)):
            return -1, aside
        return 0, aside

    def _in_article(self, i: int) -> bool:
        return any(self.role[j] == 1 for j in self._stack)

    def _landmarks(self) -> None:
        """``keeps``: elements that hold the article and can't go; ``region``: the elements that text must lie in (None: all)."""
        marks = [i for i, r in enumerate(self.role) if r == 1]
        articles = [i for i in marks if self.tag[i] == "article"] or marks
        self.keeps: set[int] = set()
        for i in articles:
            while i >= 0 and i not in self.keeps:
                self.keeps.add(i)
                i = self.parent[i]
        self.region = articles
        self.path = [0] * len(self.tag)
        for i in range(len(self.tag)):
            # a named role stands for itself, wherever it is; other elements are told by the whole path
            self.path[i] = _path(0, (self.tag[i], self.role[i])) if self.role[i] else _path(self.path[self.parent[i]] if i else 0, self.label[i])

    def candidates(self) -> list[int]:
        """Elements with text that may go: containers, and whatever has a named role."""
        return [i for i in range(1, len(self.tag)) if self.last[i] > self.first[i] and (self.role[i] or self.tag[i] in _CONTAINER)]

    # the two uses

    def observed(self) -> list[dict]:
        """One entry per path: its role, and hashes of how it is presented and of what it holds on this page."""
        total = [0]
        for t in self.texts:
            total.append((total[-1] * _FACTOR + _hash(t)) % _MOD)
        by: dict[int, list] = {}
        for i in self.candidates():
            a, b = self.first[i], self.last[i]
            held = (total[b] - total[a] * pow(_FACTOR, b - a, _MOD)) % _MOD
            entry = by.setdefault(self.path[i], [self.role[i], [], []])
            entry[1].append(" ".join(self.children[i]))
            entry[2].append(held)
        return [{"path": p, "role": r, "style": _hash("/".join(s)), "content": c[0] if len(c) == 1 else _hash(str(c))} for p, (r, s, c) in by.items()]

    def main_text(self, removed) -> str:
        n = len(self.tag)
        gone, inside, named = [False] * n, [not self.region] * n, [False] * n
        marks, may_go = set(self.region), set(self.candidates()) - self.keeps
        for i in range(1, n):
            up = self.parent[i]
            inside[i] = inside[i] or i in marks or inside[up]
            named[i] = named[up] or self.role[i] < 0 and i in may_go
        size = [0]
        for t, i in zip(self.texts, self.at, strict=True):
            size.append(size[-1] + (len(t) if inside[i] and not named[i] else 0))
        for i in range(1, n):
            low = i in may_go and self.path[i] in removed
            # without a name, a branch that holds half of what the page has to say stays
            gone[i] = gone[self.parent[i]] or low and (self.role[i] != 0 or 2 * (size[self.last[i]] - size[self.first[i]]) < size[-1])
        return "\n\n".join(t for t, i in zip(self.texts, self.at, strict=True) if inside[i] and not gone[i])


_SEEN = T.ArrayType(T.StructType([T.StructField("path", T.LongType()), T.StructField("role", T.IntegerType()),
                                  T.StructField("style", T.LongType()), T.StructField("content", T.LongType())]))
_SEEN_ARROW = pa.list_(pa.struct([("path", pa.int64()), ("role", pa.int32()), ("style", pa.int64()), ("content", pa.int64())]))


@F.arrow_udf(_SEEN)
def _observed(html: pa.Array) -> pa.Array:
    return pa.array([Page(x.as_py()).observed() if x.is_valid else [] for x in html], _SEEN_ARROW)


@F.arrow_udf(T.StringType())
def _main_text(html: pa.Array, removed: pa.Array) -> pa.Array:
    return pa.array([Page(x.as_py()).main_text(frozenset(r.as_py() or ())) if x.is_valid else "" for x, r in zip(html, removed, strict=True)], pa.string())


def _repeated(n: str) -> Column:
    """Pages of a text or child sequence on n pages, by how much it repeats."""
    return F.sum(F.col(n) * F.least(F.lit(1.0), F.log(F.col(n)) / F.lit(math.log(BASE))))


def importance(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The nodes of all hosts' trees: host, path, role, n_pages, presentation, content, importance."""
    seen = pages.select(host_and_path(F.col(f"`{url}`"))[0].alias("host"), F.explode(_observed(F.col(f"`{html}`"))).alias("e"))
    both = seen.select("host", "e.path", "e.role", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("e.style").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("e.content").alias("value")))).alias("v"))
    counts = written(both.groupBy("host", "path", "role", "v.kind", "v.value").agg(F.count(F.lit(1)).alias("n")), "site-counts")

    def measured(rows: DataFrame, *keys: str) -> DataFrame:
        by = rows.groupBy(*keys, "kind").agg(F.sum("n").alias("m"), _repeated("n").alias("again"))
        of = {k: F.sum(F.when(F.col("kind") == k, 1 - F.col("again") / F.col("m"))) for k in (0, 1)}
        return by.groupBy(*keys).agg(F.max("m").alias("m"), of[0].alias("style"), of[1].alias("content"))
    own = measured(counts, "host", "path", "role")
    every = measured(counts.groupBy("path", "role", "kind", "value").agg(F.sum("n").alias("n")), "path", "role").select(
        "path", F.col("m").alias("m_all"), F.col("style").alias("style_all"), F.col("content").alias("content_all"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    # a path that all hosts share is dealt out over sixteen keys
    both = own.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(16)).cast("int")).join(every, ["path", "salt"])
    prior = F.least(F.lit(PRIOR), F.col("m_all"))

    def drawn(name: str) -> Column:
        return (F.col("m") * F.col(name) + prior * F.col(f"{name}_all")) / (F.col("m") + prior)
    style, content = drawn("style"), drawn("content")
    named = F.col("role") != 0
    presentation = F.when(named, (F.col("role") > 0).cast("double")).otherwise(style)
    weight = F.when(named, ROLE_WEIGHT).otherwise(STYLE_WEIGHT)
    return both.select("host", "path", "role", F.col("m").alias("n_pages"), presentation.alias("presentation"), content.alias("content"),
                       (weight * presentation + (1 - weight) * content).alias("importance"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", threshold: float = THRESHOLD, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``pages`` with the main ``text`` and ``n_chars``, its code points."""
    low = written(importance(pages, html, url).where(F.col("importance") < threshold).select(F.col("host").alias("_host"), "path"), "site-removed")
    removed = low.groupBy("_host").agg(F.collect_set("path").alias("_removed"))
    row = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"))
    row = row.withColumn("_host", host_and_path(F.col("_row")[url])[0])
    if low.count() <= broadcast_limit:
        joined = row.join(F.broadcast(removed), "_host", "left")
    else:
        # a host of many pages is dealt out over as many keys as it has thousands of pages
        sizes = row.groupBy("_host").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("_n"))
        split = removed.join(sizes, "_host")
        wide = split.select("_host", "_removed", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_salt"))
        most = sizes.agg(F.max("_n")).first()[0]
        large = F.broadcast(sizes.where(f"_n > 1").limit(broadcast_limit)) if sizes.where("_n > 1").limit(broadcast_limit + 1).count() <= broadcast_limit else sizes.where("_n > 1")
        dealt = row.join(large, "_host", "left").withColumn("_salt", F.pmod(F.xxhash64("_row"), F.coalesce(F.col("_n"), F.lit(1))).cast("int")) if most and most > 1 else row.withColumn("_salt", F.lit(0))
        joined = dealt.join(wide, ["_host", "_salt"], "left")
    out = joined.select("_row", _main_text(F.col("_row")[html], F.col("_removed")).alias("text"))
    kept = [F.col("_row")[c].alias(c) for c in pages.columns if c not in ("text", "n_chars")]
    return out.select(*kept, "text", F.length("text").cast("bigint").alias("n_chars"))
