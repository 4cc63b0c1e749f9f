"""Plain versions of the text operators, for small tables."""

import hashlib
from collections import defaultdict


def words(text):
    return (text or "").encode().split()


def near_groups(rows, k=2, percent=80):
    sets = {}
    for i, t in rows:
        w = words((t or "").encode().lower().decode())
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if n else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    for i, s in sets.items():
        counts = defaultdict(int)
        for g in s:
            for j in by[g]:
                counts[j] += 1
        for j, both in counts.items():
            if j < i and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def repeated_spans(rows, window=20):
    first, docs = {}, {}
    for i, t in sorted(rows):
        docs[i] = w = words(t)
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), (i, j))
    out = {}
    for i, w in docs.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] != (i, j):
                gone[j : j + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
