"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib

import xxhash

_LOW = {i: i + 32 for i in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(_LOW))


def contamination(docs, items, n=13):
    """doc -> (n_words, hit word numbers, items)"""
    windows = {}
    for item, text in items:
        w = words(text, ALNUM)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for text in docs:
        w, hit, found = words(text, ALNUM), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                who = windows.get(tuple(w[i:i + k]))
                if who is not None:
                    hit |= set(range(i, i + k))
                    found |= {x for x in who if x is not None}
        out.append((len(w), hit, found))
    return out


def repeats(docs, n=50):
    """docs: (id, text) -> list of (mask of removed bytes, bytes)"""
    first = {}
    for i, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - n + 1 if i is not None else 0):
            first[b[p:p + n]] = min(i, first.get(b[p:p + n], i))
    out = []
    for i, text in docs:
        b = (text or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - n + 1 if i is not None else 0):
            if first[b[p:p + n]] < i:
                mask[p:p + n] = b"\1" * n
        out.append((bytes(mask), b))
    return out


def spans_of(mask):
    return [(m.start(), m.end()) for m in re.finditer(b"\1+", mask)]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def judge(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = m[1].translate(_LOW), m[2]
    fit = [(len(h) + len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[1] if best else default


def shingles(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(ids_and_texts, threshold=(85, 100)):
    """id -> (size of the set, smallest id reachable)"""
    sets = {i: shingles(t) for i, t in ids_and_texts}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if threshold[1] * both >= threshold[0] * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _xx_long(x, seed=42):
    return xxhash.xxh64_intdigest((x & (2**64 - 1)).to_bytes(8, "little"), seed=seed)


def _xx_int(x, seed):
    return _xx32(x, seed)


def _xx32(x, seed):
    return xxhash.xxh64_intdigest((x & (2**32 - 1)).to_bytes(4, "little"), seed=seed)


def fingerprint(text, k=3, bins_log2=5, picked=2):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(_LOW)) if x]
    mask33 = (1 << 33) - 1
    grams = []
    for i in range(max(1, len(w) - k + 1) if w else 0):
        h = 42
        for j in range(k):
            h = xxhash.xxh64_intdigest((w[i + j] if i + j < len(w) else "").encode(), seed=h)
        grams.append((h & mask33, i))
    seen, numbered = {}, []
    for h, i in grams:
        n = seen[h] = seen.get(h, -1) + 1
        numbered.append((_xx_int(n, _xx_long(h)) & mask33, i))
    out = []
    for b in range(1 << bins_log2):
        own = sorted(x for x in numbered if x[0] >> (33 - bins_log2) == b)[:picked]
        if own:
            h = 42
            for x, _ in sorted(own, key=lambda x: x[1]):
                h = _xx_long(x, h)
            out.append(f"{b:02X}{h & 0xFFFFFFFF:08X}")
    return ",".join(out)


def likeness(a, b):
    if a == b:
        return 1.0
    x, y = set(filter(None, a.split(","))), set(filter(None, b.split(",")))
    return len(x & y) / max(1, len({e[:2] for e in x | y}))


def deal(children, budget):
    """children: (name, capacity, weight) -> name -> whole tokens; what a full child leaves goes to the others by weight"""
    got, left = {n: 0 for n, _, w in children if not w}, [c for c in children if c[2]]
    while left:
        total = sum(w for _, _, w in left)
        full = [(n, cap) for n, cap, w in left if cap * total <= w * budget]
        if not full:
            got |= {n: w * budget // total for n, _, w in left}
            break
        # the one that is full first
        n, cap = min(full, key=lambda x: next(x[1] / w for m, _, w in left if m == x[0]))
        got[n], budget = cap, budget - cap
        left = [c for c in left if c[0] != n]
    return got


def mixture(rows, percent, epochs, seed, weights):
    """rows: (id, domain, lang, source, tokens) -> id -> copies"""
    leaves = {}
    for r in rows:
        leaves.setdefault(r[1:4], []).append(r)
    budgets = {(): sum(r[4] for r in rows) * percent // 100}
    for depth in range(3):
        for parent in [p for p in budgets if len(p) == depth]:
            caps = {}
            for leaf, own in leaves.items():
                if leaf[:depth] == parent:
                    caps[leaf[depth]] = caps.get(leaf[depth], 0) + epochs * sum(r[4] for r in own)
            for n, b in deal([(n, c, weights[depth].get(n, 1)) for n, c in caps.items()], budgets[parent]).items():
                budgets[(*parent, n)] = b
    out = {}
    for leaf, own in leaves.items():
        total, budget = sum(r[4] for r in own), budgets[leaf]
        whole, rest = divmod(budget, total) if total else (epochs, 0)
        upto = 0
        for r in sorted(own, key=lambda r: hashlib.md5(f"{seed}:{whole}:{r[0]}".encode()).hexdigest()):
            upto += r[4]
            out[r[0]] = whole + (rest > 0 and upto <= rest)
    return out


def trie(rows, group=20, heads=4):
    """(conv_id, depth, parent, members, children, leaves, saved tokens, hash of the ids that end here) of every prefix"""
    by, members, ends, kids, leaves, saved = {}, {}, {}, {}, {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % heads
        t = turns.get(c - c % group, [])[:h] + turns[c][h:]
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    for n in members:
        if n:
            kids[n[:-1]] = kids.get(n[:-1], 0) + 1
    for n in members:
        tokens = (len(members[n]) - 1) * len(SPACED.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] = saved.get(n[:d], 0) + tokens
            leaves[n[:d]] = leaves.get(n[:d], 0) + (n not in kids)
    return {(min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), kids.get(n, 0), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n in members}


_LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest_repair(rows):
    """rows: (initial, must go, truncated); cost, audit and (row or None, new role or None) of the best of all edits"""
    best = None

    def go(i, cost, audit, kept, made):
        nonlocal best
        if best and cost > best[0]:
            return
        for k in ("", "u", "a", "ua", "au"):
            c, a, w, m = cost + 2 * len(k), audit + "I" * len(k), kept + [(None, x) for x in k], made + k
            if i == len(rows):
                if _LEGAL.match(m) and (best is None or (c, a) < best[:2]):
                    best = (c, a, w)
                continue
            initial, must_go, cut = rows[i]
            go(i + 1, c + 3, a + "D", w, m)
            if not must_go:
                if initial in ("s", "u", "a"):
                    go(i + 1, c + cut, a + "K", w + [(i, None)], m + initial)
                for r in "ua":
                    go(i + 1, c + 2 + cut, a + "R", w + [(i, r)], m + r)
    go(0, 0, "", [], "")
    return best


def repairs(rows, solve):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash)"""
    by, out = {}, {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        own = by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            own += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    for c, v in by.items():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        seen, codes, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in v:
            left = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        at = [t for t, _, _ in v if t is not None]
        cost, audit, kept = solve(codes) if v else (0, "", [])
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[r] if r else v[i][1]}:{v[i][2] if i is not None else ''}" for i, r in kept]
        out[c] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out
