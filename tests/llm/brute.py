"""The numbered operators by brute force, for small inputs."""

import hashlib
from collections import Counter, defaultdict

_LOWER = bytes([c + 32 if 65 <= c < 91 else c for c in range(256)])


def shingles(text, n=5):
    w = (text or "").encode().translate(_LOWER).split()
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def jaccard_components(docs):
    """{doc_id: (size, component)} of (doc_id, text) rows of distinct ids."""
    sets = {d: shingles(t) for d, t in docs}
    lists = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            lists[x].append(d)
    shared = Counter((a, b) for ds in lists.values() for i, b in enumerate(ds) for a in ds[:i])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def without_repeats(docs, width=20):
    """{doc_id: (words, kept words)} of (doc_id, text) rows of distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if k in seen:
                gone[i : i + width] = [True] * width
            seen.add(k)
        out[d] = (w, [x for x, g in zip(w, gone) if not g])
    return out


def sha(words):
    return hashlib.sha256(b" ".join(words)).hexdigest()
