"""Plain versions of what the operators return, for small inputs."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k):
    w = words(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(rows, k, percent):
    """{doc_id: (set size, component)} for rows of (doc_id, text)."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    from collections import Counter

    for d, s in sets.items():
        met = Counter(e for x in s for e in by_shingle[x] if e < d)
        for e, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {d: (len(s), top(d)) for d, s in sets.items()}


def without_repeats(rows, window):
    """{doc_id: (words, removed, kept words)} for rows of (doc_id, text)."""
    first = {}
    split = {d: words(t) for d, t in rows}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out
