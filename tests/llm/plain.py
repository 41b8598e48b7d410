"""Plain Python versions of the training-data operators, for small inputs."""

import hashlib
import math
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _uid string, uid long, size string, key string"


def documents(spark, rows):
    """(doc_id, text, source) rows, with columns whose names clash with internal ones."""
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), "x", 7, "y", "z") for i, t, s in rows], DOC_SCHEMA
    )


def words(text):
    return (text or "").encode().split()


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def repeats_removed(texts):
    """texts: in document order.  (n_words, n_removed, kept text) of each."""
    seen, out = set(), []
    for text in texts:
        w = words(text)
        keep = [True] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                keep[p : p + 20] = [False] * 20
            seen.add(key)
        out.append((len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return out


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard_classes(texts, percent=75):
    sets = [shingle_set(t) for t in texts]
    groups = Groups(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                groups.join(a, b)
    return [len(s) for s in sets], [groups.find(i) for i in range(len(sets))]


def vector_links(rows, least=0.93):
    """rows: (id, vector, label).  id -> (links, component)."""

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        n = math.sqrt(math.fsum(x * x for x in v))
        return [x / n for x in v]

    units = {i: unit(v) for i, v, _ in rows}
    label = {i: c for i, _, c in rows}
    groups, links = Groups(units), Counter()
    for a in units:
        for b in units:
            if a < b and units[a] and units[b] and label[a] is not None and label[a] == label[b]:
                if sum(x * y for x, y in zip(units[a], units[b])) >= least:
                    groups.join(a, b)
                    links.update((a, b))
    return {i: (links[i], groups.find(i)) for i in units}


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """sizes: source -> words."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_ones, out = share * sum(sizes.values()), set(names), {}
    while open_ones:
        total = sum(weight[s] for s in open_ones)
        above = {s for s in open_ones if left * weight[s] / total > most * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in open_ones}
        for s in above:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in above)
        open_ones -= above
    return out


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_source(rows):
    out = defaultdict(int)
    for source, size in rows:
        out[source] += size
    return dict(out)
