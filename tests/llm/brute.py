"""Plain Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict


def remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows):
    """[(doc_id, n_shingles, component)] of (doc_id, text) rows with distinct ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for d, s in sets.items():
        shared = Counter(e for g in s for e in having[g])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
        for g in s:
            having[g].append(d)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def repeats(rows, span=200):
    """doc_id -> (bytes, removed, runs, sha256 of the rest)."""
    data = {d: (t or "").encode() for d, t in rows}
    seen = Counter(b[i : i + span] for b in data.values() for i in range(len(b) - span + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        rest = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return out


def leaks(rows, items, least=0.75):
    """(doc_id, item_id) -> (similarity, first word) of windows of the item's length."""
    def grams(t):
        w = words(t)
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)], len(w)

    def mass(s):
        return sum(sum(map(len, g)) + g_gaps for g, g_gaps in ((g, 4) for g in s))

    out = {}
    for d, t in rows:
        x, n = grams(t)
        for i, text in items:
            y, m = grams(text)
            if not x or not y or not set(x) & set(y):
                continue
            span = min(n, m) - 4
            best = max((mass(set(y) & set(x[p : p + span])) / mass(set(y) | set(x[p : p + span])), -p) for p in range(len(x) - span + 1))
            if best[0] >= least:
                out[(d, i)] = (best[0], -best[1])
    return out


def unigrams(rows):
    """doc_id -> (held_out, tokens, known, N, base score)."""
    count = Counter()
    for d, t in rows:
        if remainder(d, 7) != 2:
            count.update(words(t))
            count["end"] += 1
    total, kinds = sum(count.values()), len(count)
    out = {}
    for d, t in rows:
        line = [*words(t), "end"]
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in line)
        out[d] = (remainder(d, 7) == 2, len(line), sum(count[w] > 0 for w in line), total, base)
    return out


def best(vectors, k=10):
    """query -> [(vec_id, score)] of (vec_id, vector) rows with distinct ids."""
    whole = {
        i: [math.floor(1024 * x) for x in v]
        for i, v in vectors
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    }
    out = {}
    for q in whole:
        if q % 100 == 0:
            scored = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out
