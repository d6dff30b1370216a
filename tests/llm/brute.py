"""Plain single-machine versions of the contracts, for comparison."""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def repeats(rows, length=200):
    """rows: (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i:i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mark = np.cumsum(gone)[:-1] > 0
        spans = int((mark & ~np.concatenate([[False], mark[:-1]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~mark]) if len(b) else b""
        out.append((d, len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for i, t in items:
        w = word.findall(_lower(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k:k + 10])].add(str(i))
    sizes = sorted({len(w) for w in wins})
    out = []
    for d, t in docs:
        w = word.findall(_lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                got = wins.get(tuple(w[k:k + n]))
                if got:
                    hit.update(range(k, k + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def warc(pages):
    last = {}
    for p, h in pages:
        b = (h or "").encode()
        if p is not None:
            last[b] = max(last.get(b, p), p)
    out = []
    for p, h in pages:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = last.get(b) is None or last[b] == p
        out.append((p, len(b), digest, "response" if first else "revisit", None if first else last[b]))
    return out


def token_ids(texts, path, end):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], dtype="<u4") for x in texts]


def token_rows(rows, path, end):
    out, at = [], 0
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for (d, _), ids in zip(rows, token_ids([t for _, t in rows], path, end)):
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        rep = {i + j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), failed))
    return out


def normal(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")


def common_lines(rows, min_docs, ratio):
    """rows: (doc_id, text, host) -> {(host, line)}."""
    having, total = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        total[h].add(t)
        for x in (t or "").split("\n"):
            if normal(x):
                having[h, normal(x)].add(t)
    return {k for k, v in having.items() if len(v) >= min_docs and len(v) > ratio * len(total[k[0]])}


def kept_by_rules(rows, min_docs=2, ratio=0.1, min_kept=0.3):
    common = common_lines(rows, min_docs, ratio)
    out = []
    for (d, t, h), b in zip(rows, base_rules([r[:2] for r in rows])):
        gone = sum(len(normal(x).split(" ")) for x in (t or "").split("\n") if (h, normal(x)) in common)
        out.append((*b, not b[6] and not b[1] - gone < min_kept * b[1], gone))
    return out


def without_common_lines(rows, min_docs=2, ratio=0.05):
    common = common_lines(rows, min_docs, ratio)
    out = []
    for d, t, h in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if (h, normal(x)) not in common]
        out.append((d, t if len(left) == len(lines) else "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def secrets(rows):
    pats = (("assign", re.compile(r"""((?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
             lambda m: len(m[2]) >= 8),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
            ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32))
    out = []
    for d, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(pats) for m in p.finditer(t or "") if ok(m))
        text = ",".join(f"{pats[k][0]}:{s}:{e}" for s, k, e in spans)
        n = [sum(k == i for _, k, _ in spans) for i in range(3)]
        out.append((d, *n, hashlib.sha256(text.encode()).hexdigest(), text))
    return out


def near(rows, percent=75):
    sets = []
    for d, t in rows:
        w = WORD.findall(_lower(t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            by[g].append(i)
    shared = Counter()
    for members in by.values():
        for x in range(len(members)):
            for y in range(x):
                shared[members[y], members[x]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return out


def spelling(rows, min_count=5, slip_every=199, times=5):
    """rows: (doc_id, text) -> (word, form, root, n, n_near, form_n)."""
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = _lower(w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w if h % slip_every else w[:h % len(w)] + w[h % len(w) + 1:]] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= min_count}
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        k = len(os.path.commonprefix([a, b]))
        return a[k:] == b[k + 1:]

    def near(w):
        return [x for k in (-1, 0, 1) for x in by_length[len(w) + k] if x != w and one_edit(w, x)]

    form, count = {}, {}
    for w, k in words.items():
        found = sorted(near(w), key=lambda x: (-words[x], x))
        count[w] = len(found)
        form[w] = found[0] if found and words[found[0]] >= times * k else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), k, count[w], words.get(form[w])) for w, k in words.items()]


def _hex(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _tree(nodes):
    """(root, for each node its siblings from the leaf up as (before, after))."""
    paths, at, row = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(row) > 1:
        for p, i in zip(paths, at):
            p.append(("".join(row[i - i % 3:i]), "".join(row[i + 1:i - i % 3 + 3])))
        row, at = [_hex("".join(row[i:i + 3])) for i in range(0, len(row), 3)], [i // 3 for i in at]
    return row[0], paths


def merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    def leaf(r):
        return _hex("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    trees = defaultdict(list)
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        trees[r[1]].append((r[0], leaf(r), leaf((*r[:4], r[4].replace("\n", ""))) if tampered else leaf(r)))
    keys = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for k in keys:
        trees[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    low = {k: _tree([x[1] for x in trees[k]]) for k in keys}
    top, high = _tree([low[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, up in zip(keys, high):
        for (d, own, held), path in zip(trees[k], low[k][1]):
            for before, after in path + up:
                held = _hex(before + held + after)
            out.append((d, own, low[k][0], top, _hex("".join(b + a for b, a in path + up)), held, held == top))
    return out


def language_entropy(learned, text):
    """Bits a character of ``text`` in the interpolated Kneser-Ney model of order 5 of each language; {} without letters.

    learned: {language: texts}.
    """
    def letters(t):
        return re.sub(" +", " ", "".join(c.lower() if len(c.lower()) == 1 else c for c in
                                         ("".join(x if x.isalpha() else " " for x in t or "") + " "))).lstrip(" ")

    grams = {}
    for g, texts in learned.items():
        c = Counter()
        for t in texts:
            s = letters(t)
            padded = "    " + s
            c.update(padded[i:i + 5] for i in range(len(s)))
        if c:
            grams[g] = [c]
    alphabet = len({w[-1] for levels in grams.values() for w in levels[0]}) + 1
    for levels in grams.values():
        while len(levels) < 5:
            levels.insert(0, Counter(w[1:] for w in levels[0]))
    s = letters(text)
    out = {}
    for g, levels in grams.items() if s else ():
        cut = []
        for c in levels:
            one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            cut.append(one / (one + 2 * two) if one and two else 0.5)
        tables = []
        for c in levels:
            total, types = Counter(), Counter()
            for w, v in c.items():
                total[w[:-1]] += v
                types[w[:-1]] += 1
            tables.append((total, types))

        def p(w, k):
            if k == 0:
                return 1 / alphabet
            w = w[-k:]
            (total, types), d, lower = tables[k - 1], cut[k - 1], p(w, k - 1)
            if not total[w[:-1]]:
                return lower
            return (max(levels[k - 1][w] - d, 0) + d * types[w[:-1]] * lower) / total[w[:-1]]

        padded = "    " + s
        out[g] = -sum(np.log2(p(padded[i:i + 5], 5)) for i in range(len(s))) / len(s)
    return out
