"""Plain single-machine versions of the corpus operators, to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def union_find(n):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    return up, root


def removed_bytes(docs, least=50):
    """doc_id -> (bytes, removed, spans, sha256 of the rest); docs: (doc_id, text), one row a doc_id."""
    texts = sorted((d, (t or "").encode()) for d, t in docs)
    first = {}
    for d, x in texts:
        for p in range(len(x) - least + 1):
            first.setdefault(x[p:p + least], d)
    out = {}
    for d, x in texts:
        cover = bytearray(len(x))
        for p in range(len(x) - least + 1):
            if first[x[p:p + least]] < d:
                cover[p:p + least] = b"\1" * least
        kept = bytes(c for c, gone in zip(x, cover) if not gone)
        out[d] = (len(x), sum(cover), len([s for s in bytes(cover).split(b"\0") if s]), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    words = text.encode().lower().split() if text else []
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def near_groups(docs):
    """doc_id -> (set size, smallest doc_id reachable)."""
    rows = sorted(docs)
    sets = [shingles(t) for _, t in rows]
    up, root = union_find(len(rows))
    posted = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in posted[x])
        for j, both in common.items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for x in s:
            posted[x].append(i)
    return {d: (len(sets[i]), rows[root(i)][0]) for i, (d, _) in enumerate(rows)}


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def benchmark_hits(docs, items):
    """doc_id -> (words, hit words, item ids)."""
    phrases = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        for j in range(max(1, len(w) - 9) if w else 0):
            phrases[tuple(w[j:j + 10])].add(str(i))
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").encode().lower())
        hit, found = set(), set()
        for n in {len(p) for p in phrases}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in phrases:
                    hit.update(range(j, j + n))
                    found |= phrases[tuple(w[j:j + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def edit_at_most_1(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def kept_lines(docs, least=20):
    """doc_id -> text without lines that an earlier one equals but for one edit."""
    seen, out = [], {}
    for d, t in sorted(docs):
        if t is None:
            out[d] = None
            continue
        kept = []
        for line in t.split("\n"):
            if len(line) >= least:
                if any(edit_at_most_1(line, x) for x in seen):
                    seen.append(line)
                    continue
                seen.append(line)
            kept.append(line)
        out[d] = "\n".join(kept)
    return out
