"""DuckDB SQL twins of the queries that SQL can express."""

from __future__ import annotations

from tabsight.llm import mixing, urls

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, ws, least(13, len(ws)) AS k FROM (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}') AS ws FROM benchmark) WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM b, unnest(range(1, len(ws) - k + 2)) AS t(i)),
sizes AS (SELECT DISTINCT k FROM windows),
runs AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(ws) - k + 2)) AS t(i)),
found AS (SELECT doc_id, i, k, item_id FROM runs JOIN windows USING (k, win)),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT DISTINCT doc_id, i, k FROM found), unnest(range(0, k)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.listed, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# bytes as hexadecimal digits, two for each
REPEATED_PASSAGES = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
starts AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM d, unnest(range(0, length(x) // 2 - 49)) AS t(p)),
firsts AS (SELECT s, min(doc_id) AS least FROM starts GROUP BY s),
gone AS (SELECT doc_id, p, lag(p) OVER w AS before, lead(p) OVER w AS after FROM starts JOIN firsts USING (s) WHERE doc_id > least WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
cover AS (SELECT doc_id, sum(least(50, coalesce(after - p, 50))) AS n, sum(CASE WHEN before IS NULL OR p - before > 50 THEN 1 ELSE 0 END) AS spans FROM gone GROUP BY doc_id),
-- what is left: up to a span's first byte, and from each span's end to the next span
ends AS (SELECT doc_id, p + 50 AS a, coalesce(after, 1000000000) AS b FROM gone WHERE after IS NULL OR after - p > 50
         UNION ALL SELECT doc_id, 0, min(p) FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM ends JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)

URL_FILTER = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(verdict, rule_host, rule_path) AS (VALUES {_RULES}),
fit AS (SELECT page_id, max(struct_pack(n := length(rule_host) + length(rule_path), verdict := verdict, rule := rule_host || rule_path)) AS best
        FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, '{urls.DEFAULT}') AS verdict FROM parts LEFT JOIN fit USING (page_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '{_SPACED}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, sym.y FROM reach JOIN sym ON sym.x = reach.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def _weight(name: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in sorted(weights.items())) + f" ELSE {mixing.DEFAULT_WEIGHT} END" if weights else str(mixing.DEFAULT_WEIGHT)


def _mixing() -> str:
    ctes, up, budget = [], [], "target"
    for level, weights in (("domain", mixing.DOMAIN_WEIGHTS), ("lang", mixing.LANG_WEIGHTS), ("source", {})):
        names = [*up, level]
        of, key = ("PARTITION BY " + ", ".join(up) if up else ""), ", ".join(names)
        join = f"JOIN {budget} USING ({', '.join(up)})" if up else f"CROSS JOIN {budget}"
        ctes.append(f"""
{level}_nodes AS (SELECT n.*, b.budget, {_weight(level, weights)} AS w FROM (SELECT {key}, CAST(sum(tokens * {mixing.MAX_EPOCHS}) AS HUGEINT) AS cap FROM leaves GROUP BY {key}) n {join.replace(budget, budget + ' b')}),
{level}_order AS (SELECT *, coalesce(sum(cap) OVER (e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier, sum(w) OVER (e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later_w
    FROM {level}_nodes WINDOW e AS ({of} ORDER BY CAST(cap AS DOUBLE) / w, {level})),
{level}_full AS (SELECT *, cap * later_w <= w * (budget - earlier) AS is_full FROM {level}_order),
{level}_got AS (SELECT {key}, CAST(CASE WHEN is_full THEN cap ELSE (w * (budget - coalesce(sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER o, 0))) // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER o END AS HUGEINT) AS budget
    FROM {level}_full WINDOW o AS ({of}))""")
        up, budget = names, f"{level}_got"
    return rf"""
WITH r AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) AS BIGINT) AS n_tokens,
    regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS no FROM documents),
t AS (SELECT *, CASE WHEN no = '' OR no = '0' THEN 'crawl' WHEN length(no) = 1 THEN 'web' ELSE 'curated' END AS domain FROM r),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM t GROUP BY ALL),
target AS (SELECT CAST(sum(n_tokens) AS HUGEINT) * {mixing.TARGET_PERCENT} // 100 AS budget FROM t),{','.join(ctes)},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE {mixing.MAX_EPOCHS} END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
    FROM leaves JOIN {budget} USING (domain, lang, source)),
keyed AS (SELECT t.*, epochs, rest, md5('{mixing.SEED}:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS k FROM t JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS n_copies FROM summed
"""


_DECODED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&quot;?', '"', 'g'), '&#(x27|39);', '''', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')"""

# pages whose article is marked by ``article`` and whose blocks are headings and paragraphs, as the tables' are
HTML_EXTRACTION = rf"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?b>', '', 'g') AS body FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(string_split_regex(body, '</?(p|h1)>'),
             lambda x: trim(regexp_replace({_DECODED.format("replace(x, '<br>', ' ')")}, '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM b
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda a, b: "
            "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)")


PREFIX_TRIE = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM r),
m AS (SELECT conv_id, depth, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k,
             len(regexp_extract_all(text, '{_SPACED}')) AS words FROM d
      UNION ALL SELECT conv_id, 0, '', 0 FROM c),
steps AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(k) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS is_last FROM m),
nodes AS (SELECT depth, k, min(up) AS up, count(*) AS n_convs, min(conv_id) AS conv_id, (count(*) - 1) * max(words) AS tokens,
                 string_agg(CASE WHEN is_last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM steps GROUP BY depth, k),
kids AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (SELECT a.depth, a.k, sum(tokens) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves
         FROM nodes v LEFT JOIN kids ON kids.depth = v.depth AND kids.k = v.k JOIN m a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM nodes v JOIN sums ON sums.depth = v.depth AND sums.k = v.k LEFT JOIN kids ON kids.depth = v.depth AND kids.k = v.k
LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.k = v.up
"""


def _repair() -> str:
    """Costs have nine digits and their audit behind them, so that the least string is the cheapest and then the least audit."""
    def f(on: str, cost: str, letter: str) -> str:
        return f"(lpad(CAST(CAST(substr({on}, 1, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({on}, 10))"

    def keep(initial: str, on: str) -> str:
        return f"CASE WHEN x[1] = '{initial}' AND x[2] = '0' THEN {f(on, 'CAST(x[3] AS INT)', 'K')} END"

    def reroled(on: str) -> str:
        return f"CASE WHEN x[2] = '0' THEN {f(on, '2 + CAST(x[3] AS INT)', 'R')} END"
    start = f"least({f('s[1]', '3', 'D')}, {keep('s', 's[2]')}, {keep('u', 's[3]')}, {reroled('s[3]')})"
    system = f"least({f('s[2]', '3', 'D')}, {keep('u', 's[3]')}, {reroled('s[3]')})"
    user = f"least({f('s[3]', '3', 'D')}, {keep('a', 's[4]')}, {reroled('s[4]')})"
    assistant = f"least({f('s[4]', '3', 'D')}, {keep('u', 's[3]')}, {reroled('s[3]')})"
    user_in = f"least({user}, {f(assistant, '2', 'I')})"
    step = f"[least({start}, {f(user_in, '2', 'I')}), least({system}, {f(user_in, '2', 'I')}), {user_in}, least({assistant}, {f(user, '2', 'I')})]"
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS harm
           FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
      FROM c, unnest(CASE WHEN harm = 0 THEN [] WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS t(copy)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, copy) AS pos, left(role, 1) AS ini, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM b),
g AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                     WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(ini) OVER (PARTITION BY conv_id ORDER BY pos) || ini NOT IN ('su', 'ua', 'au') AS bad FROM r),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal,
             list([ini, CAST(CAST(fault IN ('blank', 'duplicate') AS INT) AS VARCHAR), CAST(CAST(fault = 'truncated' AS INT) AS VARCHAR)] ORDER BY pos DESC) AS codes FROM g GROUP BY conv_id),
s AS (SELECT *, list_reduce(list_prepend(['000000000', '000000004II', '000000002I', '000000000'], codes), lambda s, x: {step})[1] AS best FROM n),
l AS (SELECT conv_id, i, substr(best, 9 + i, 1) AS letter FROM s, unnest(range(1, length(best) - 8)) AS t(i)),
o AS (SELECT conv_id, i, letter, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS nth FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
q AS (SELECT o.*, g.role, g.text, max(CASE WHEN nth = 1 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS skip
      FROM o LEFT JOIN g ON g.conv_id = o.conv_id AND g.pos = o.pos AND letter <> 'I'),
z AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - skip) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS lines
      FROM q WHERE letter <> 'D' GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(substr(best, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM c) e LEFT JOIN s USING (conv_id) LEFT JOIN z USING (conv_id)
"""


CONVERSATION_REPAIR = _repair()


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": DECONTAMINATION, "op2_repeated_passages": REPEATED_PASSAGES, "op4_url_filter": URL_FILTER,
            "op5_near_duplicates": NEAR_DUPLICATES, "op10_mixing": _mixing(), "op11_html_extraction": HTML_EXTRACTION, "op12_prefix_trie": PREFIX_TRIE,
            "op13_conversation_repair": CONVERSATION_REPAIR}
