"""Plain definitions of the dealt operators' results, for small inputs."""

import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_groups(docs, n=5, threshold=80):
    """{doc_id: (set size, component)} over unique ids, by all pairs."""
    sets = {}
    for i, t in docs:
        w = SPACED.findall((t or "").translate(LOWER))
        k = min(n, len(w))
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for p, a in enumerate(ids):
        for b in ids[p + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: (len(s), root(i)) for i, s in sets.items()}


def kept_lines(docs, min_docs):
    """{doc_id: (lines, dropped, kept text)}."""
    strip = " \t\n\x0b\x0c\r"
    keys = {i: [line.strip(strip).translate(LOWER) for line in (t or "").split("\n")] for i, t in docs}
    found = Counter(k for own in keys.values() for k in set(own))
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x, k in zip(lines, keys[i]) if not k or found[k] < min_docs]
        out[i] = (len(lines), len(lines) - len(left), "\n".join(left))
    return out


def benchmark_hits(docs, items, window):
    """{doc_id: (words, hit words, items)}."""
    phrases = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            phrases.setdefault(tuple(w[a:a + k]), set()).add("null" if i is None else str(i))
    out = {}
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, own = set(), set()
        for k in {len(p) for p in phrases}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in phrases:
                    hit.update(range(a, a + k))
                    own |= phrases[tuple(w[a:a + k])]
        out[i] = (len(w), len(hit), sorted(own))
    return out


def quality(t):
    """(words, their characters, symbols, lines with a word, repeated lines, repeated words)."""
    t = t or ""
    w = SPACED.findall(t)
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)),
            len(again))
