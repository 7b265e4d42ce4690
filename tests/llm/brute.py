"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from itertools import combinations


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    n = min(k, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(docs, k=4, percent=80):
    """{doc_id: smallest reachable id} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingle_set(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def near(a, b):
    """At most one edit apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :] or a == b


def kept_lines(docs, min_chars=24):
    """{doc_id: text} with repeated lines dropped, of (doc_id, text) rows with distinct ids."""
    exact, seen, out = set(), [], {}
    for i, t in sorted(docs, key=lambda r: r[0]):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            if not line.strip(" \r\t"):
                kept.append(line)
                continue
            if line not in exact and not (len(line) >= min_chars and any(len(s) >= min_chars and near(line, s) for s in seen)):
                kept.append(line)
            if line not in exact:
                exact.add(line)
                seen.append(line)
        out[i] = "\n".join(kept)
    return out


def windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(10, len(w))
    return w, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def contaminated(docs, items):
    """{doc_id: (n_words, n_hit, sorted item ids)}"""
    known = [(str(i), windows(t)[1]) for i, t in items if i is not None]
    out = {}
    for d, t in docs:
        w, _ = windows(t)
        hit, ids = set(), set()
        for item, ws in known:
            for x in ws:
                for s in range(len(w) - len(x) + 1):
                    if tuple(w[s : s + len(x)]) == x:
                        hit |= set(range(s, s + len(x)))
                        ids.add(item)
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def top_k(vectors, k=5, step=50):
    import math

    rows = [(i, [math.floor(256 * float(x)) if abs(x) < 1e300 else 256 * int(x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in rows:
        if q % step == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
            out[q] = [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in found]
    return out
