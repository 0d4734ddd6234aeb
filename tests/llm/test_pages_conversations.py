"""Operators on pages and conversations against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tabsight.llm import conversation_repair, prefix_trie, site_tree
from tabsight.llm._order import positions, sha256_in_order
from tabsight.llm._text import ship

from . import brute

PAGES = "page_id bigint, url string, html string"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def main_text(html, removed=()):
    return site_tree.Page(html).main_text(removed)


def noise(html):
    """Text with all branches gone that the markup itself names as something else."""
    page = site_tree.Page(html)
    return page.main_text({page.path[i] for i in page.candidates() if page.role[i] < 0})


@pytest.mark.parametrize("html, text", [
    ("<p>a  b\n c</p><p>d<p>e", "a b c\n\nd\n\ne"),
    ("<p><b>one<br>two<p>three", "one two\n\nthree"),
    ("<P CLASS=x>T&amp;T &lt;b&gt; &eacute;&#233;&#xe9; &nbsp; &copy 1</P>", "T&T <b> ééé © 1"),
    ("<script>var t='</p>';</script><style>p{}</style><title>t</title><p>x</p><noscript>no</noscript><!-- <p>hid</p> -->", "x"),
    ("<script>never closed <p>x</p>", ""),
    ("<ul><li>a<li>b</ul>c<table><tr><td>d<td>e<tr><td>f</table>", "a\n\nb\n\nc\n\nd\n\ne\n\nf"),
    ("<article><h1>H</h1><div>in</div></div></section></article><p>out</p>", "H\n\nin"),
    ("<a title='1 > 0' href=x>link</a> text <img alt=y> <input value=z><select><option>o</select>", "link text"),
    ("a < b and <3 <p>cut <a hr", "a < b and <3\n\ncut"),
    ("<head><title>t</title><p>body", "body"),
    ("", ""), ("   \n", ""), ("plain", "plain"), ("<>", "<>"), ("</p></p>", ""),
])
def test_markup(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<nav>m</nav><header>h</header><article><header><h1>T</h1></header><p>x</p><aside>s</aside><footer>f</footer></article><footer>f</footer>", "T\n\nx"),
    ("<div class='ad'>a</div><div id=cookie-notice>c</div><form>q</form><p>x</p><div class='siteFooter'>f</div><p class=sponsored>s</p>", "x"),
    ("<main><p>x</p><section id=comments><article class=comment><p>first!</p></article><article><p>second</p></article></section></main>", "x"),
    ("<form id=aspnetForm><div class=has-sidebar><article><p>x</p></article></div></form>", "x"),
    ("<div role=navigation>n</div><div role=main><p>x</p></div><div role=dialog>d</div>", "x"),
    ("<article><p>first</p></article><div>between</div><article><p>second</p></article>", "first\n\nsecond"),
])
def test_named_roles(html, text):
    assert noise(html) == text


def test_site_tree_learns_what_repeats(spark):
    """Branches without a telling name go where they repeat on the host; articles, copies and common lines stay."""
    ship(spark)
    draw = random.Random(4)

    def prose(n):
        return " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(n)) + "."
    strips, common, copy = [prose(6) for _ in range(3)], prose(9), prose(40)
    rows, want = [], {}
    for i in range(120):
        own = copy if i % 3 == 0 else prose(30)
        body = f"<p>{own}</p><p>{common}</p>"
        strip = f"<div class=x{i}q><div>{draw.choice(strips)}</div></div>"
        host = f"http://www.{'big' if i < 90 else 'b%d' % (i % 4)}.example.com/p{i}"
        if i % 2:
            html = f"<body>{strip}<div class=c><h2>T{i}</h2>{body}</div><div class=y>{strips[0]}</div></body>"
            want[i] = f"T{i}\n\n{own}\n\n{common}"
        else:
            html = f"<body><nav>{prose(4)}</nav><article>{body}<div class=z>{strips[1]}</div></article><footer>&copy; {prose(3)}</footer>"
            want[i] = f"{own}\n\n{common}"
        rows.append((i, host, html))
    frame = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1)).withColumn("_host", F.lit("mine")).repartition(3)
    for limit in (500_000, 0):
        got = site_tree.extract(frame, broadcast_limit=limit).collect()
        assert {r.page_id: r.text for r in got} == want
        assert all(r.n_chars == len(r.text) and r._host == "mine" for r in got)
    nodes = site_tree.importance(frame).collect()
    assert all(0 <= r.importance <= 1 for r in nodes) and {r.role for r in nodes} == {-1, 0, 1}
    assert all((r.importance < 0.5) == (r.role < 0) for r in nodes if r.role)


def test_extraction_of_odd_pages(spark):
    ship(spark)
    rows = [(1, None, "<p>a</p>"), (2, "no host", None), (3, "http://h/", ""), (3, "http://h/", ""), (None, "http://h/x", "<div>" * 3000 + "deep" + "</section>" * 3000),
            (5, "http://h/long", "<p>" + "word " * 200_000), (6, "http://h/q", '<a b="' * 2000 + "x"), (7, "http://h/same", "<div>t</div>"), (8, "http://h/same", "<div>t</div>")]
    got = site_tree.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[i].text for i in (1, 2, 3, None)] == ["a", "", "", "deep"] and by[5].n_chars == 999_999
    assert by[7].text == by[8].text == "t"
    assert site_tree.extract(spark.createDataFrame([], PAGES)).count() == 0


@pytest.fixture(scope="module")
def talks():
    draw = random.Random(2)
    rows = []
    for c in range(90):
        for t in range(draw.choice([1, 2, 3, 5, 9, 24])):
            rows.append((c, t if t or draw.random() < 0.8 else None, draw.choice(["user", "assistant", "system", None, "", "tool"]),
                         draw.choice(["a b.", "a", "c d  e! ", "", None, "x?\n", " \t", "é. "])))
    rows += [(c, t, "user", x) for c in range(100, 160) for t, x in enumerate(["hi there", "yo."] * 3)]
    rows += [(999, t, "user", "long way") for t in range(70)] + [(-41, 0, "user", "hi there"), (-60, 0, "user", "neg"), (None, 1, "user", "x"), (2000, None, None, None)]
    return rows


@pytest.mark.parametrize("small, run", [(10, 4), (100_000, 1024)])
def test_prefix_trie(spark, talks, small, run):
    ship(spark)
    frame = spark.createDataFrame(talks, CONVERSATIONS).withColumn("k1", F.lit(1)).repartition(3)
    assert {tuple(r) for r in prefix_trie.build(frame, small=small, run=run).collect()} == brute.trie(talks)


def test_prefix_trie_of_little(spark):
    ship(spark)
    none = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.build(none).count() == 0
    one = [(7, 1, "user", "a b"), (7, 1, "user", "a b")]
    assert {tuple(r) for r in prefix_trie.build(spark.createDataFrame(one, CONVERSATIONS)).collect()} == brute.trie(one)


def test_list_ranking(spark):
    n = 500
    order = random.Random(3).sample(range(n), n)
    rows = [(a, a % 7, b, b % 7 if b is not None else None, 1, a, 2 * a) for a, b in zip(order, [*order[1:], None], strict=True)]
    frame = spark.createDataFrame(rows, "conv bigint, k bigint, to_conv bigint, to_k bigint, arcs bigint, leaves bigint, tokens bigint")
    got = {r.conv: (r.arcs, r.leaves, r.tokens) for r in prefix_trie.rank(frame, small=20).collect()}
    assert got == {a: (n - i, sum(order[i:]), 2 * sum(order[i:])) for i, a in enumerate(order)}


def block_by_block(codes, block):
    """Cost and audit by agendas over blocks and the chain of their tables."""
    text = "".join("d" if gone else (c if c and c in "sua" else "x").upper() if cut else c if c and c in "sua" else "x" for c, gone, cut in codes)
    parts = [text[k:k + block] for k in range(0, len(text), block)]
    states = conversation_repair.STATES
    found = []
    for p in parts:
        ends = {q: conversation_repair.agenda(p, q) for q in states}
        found.append([sorted(((*ends[q][s], q) for q in states if s in ends[q]), key=lambda o: o[1]) for s in states])
    cost, path = conversation_repair.derive([[[(c, k, q) for k, (c, _, q) in enumerate(o)] for o in t] for t in found])
    audit = "".join(next(a for _, a, q in t[s] if q == e) for t, (s, e) in zip(found, path, strict=True))
    return cost, audit + conversation_repair.CLOSE[path[-1][1]][1]


def test_agenda_finds_the_lightest_derivation():
    draw = random.Random(0)
    for _ in range(250):
        codes = [(draw.choice(["s", "u", "a", "u", "a", "x", ""]), draw.random() < 0.15, int(draw.random() < 0.3)) for _ in range(draw.randint(1, 4))]
        want = brute.cheapest_repair(codes)[:2]
        for block in (1, 2, 10):
            assert block_by_block(codes, block) == want, codes


def replayed(codes):
    """The edits of ``block_by_block``'s audit."""
    cost, audit = block_by_block(codes, 10**6)
    kept, i, state = [], 0, conversation_repair.START
    for letter in audit:
        write = conversation_repair.WRITES[state]
        if letter in "IR":
            kept.append((i if letter == "R" else None, write))
            state = conversation_repair.STEP[state, write]
        elif letter == "K":
            kept.append((i, None))
            state = conversation_repair.STEP[state, codes[i][0]]
        i += letter != "I"
    return cost, audit, kept


def test_conversation_repair(spark, talks):
    ship(spark)
    frame = spark.createDataFrame(talks, CONVERSATIONS).withColumn("pos", F.lit("mine")).repartition(3)
    want = brute.repairs(talks, replayed)
    for block in (4, 256):
        got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(frame, block).collect()}
        assert got == want
    assert all(re.fullmatch("[DIKR]*", w[6]) for w in want.values())
    assert conversation_repair.repair(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_short_conversations_against_all_edits(spark):
    ship(spark)
    draw = random.Random(8)
    rows = [(c, t, draw.choice(["user", "assistant", "system", None]), draw.choice(["a.", "b", "", "long text " * 5000 + "."])) for c in range(80) for t in range(draw.randint(1, 3))]
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert got == brute.repairs(rows, brute.cheapest_repair)


def test_places_and_hashes_over_ranges(spark):
    rows = [(1, i // 3) for i in range(5000)] + [(2, 5), (None, 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, parts = positions(spark.createDataFrame(rows, "k bigint, v int").repartition(4), "k", [F.col("v")], "places")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = parts.select(F.col("k").alias("key"), F.col("part").alias("range"), "first_at", "before")
    at = placed.join(own, F.col("k").eqNullSafe(F.col("key")) & (F.col("part") == F.col("range"))).select("k", "v", (F.col("at") - F.col("first_at") + F.col("before")).alias("pos")).collect()
    assert sorted(r.pos for r in at if r.k == 1) == list(range(5000)) and all(r.v == r.pos // 3 for r in at if r.k == 1)
    assert [r.pos for r in at if r.k != 1] == [0, 0] and parts.where("k = 1").count() > 1
    pieces = spark.createDataFrame([("a", 2, "y"), ("a", 1, "é"), ("b", 1, ""), ("a", 3, "")], "k string, o int, p string").repartition(3)
    assert {r.k: r.sha256 for r in sha256_in_order(pieces, "k", "o", "p", ",").collect()} == {
        "a": hashlib.sha256("é,y,".encode()).hexdigest(), "b": hashlib.sha256(b"").hexdigest()}
