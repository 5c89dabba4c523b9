"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(docs, k):
    out = {}
    for i, t in docs:
        w = WORDS.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def components(docs, k, percent=80):
    s = sets(docs, k)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    held = defaultdict(list)
    for i, a in s.items():
        for j, n in Counter(j for x in a for j in held[x]).items():
            if 100 * n >= percent * (len(a) + len(s[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for x in a:
            held[x].append(i)
    return {i: (len(s[i]), find(i)) for i in s}


def without_repeats(docs, window):
    words = [(i, WORDS.findall(t or "")) for i, t in docs]
    count = Counter(tuple(w[p : p + window]) for _, w in words for p in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def without_seen(docs, window):
    first = {}
    raw = sorted(((i, (t or "").encode()) for i, t in docs))
    for i, t in raw:
        for p in range(len(t) - window + 1):
            first.setdefault(t[p : p + window], i)
    out = []
    for i, t in raw:
        gone = set()
        for p in range(len(t) - window + 1):
            if first[t[p : p + window]] < i:
                gone.update(range(p, p + window))
        spans = sum(1 for q in gone if q - 1 not in gone)
        out.append((i, len(t), len(gone), spans, hashlib.sha256(bytes(b for q, b in enumerate(t) if q not in gone)).hexdigest()))
    return out
