import random
from itertools import permutations

import numpy as np
import pyarrow as pa

from flowloom.llm.filter_audit import ORDERS, audit_filters, removal_ranks, text_masks
from flowloom.llm.words import blocks

DOCS = "doc_id long, text string, lang string, id long, part string, mask int, n long, digest string, good int"


def plain(rows, labels):
    """rows: (id, text, lang); labels: (id, quality, toxic)."""
    texts = [t or "" for _, t, _ in rows]
    earlier = {}
    for (i, _, _), t in zip(rows, texts):
        earlier[t] = min(earlier.get(t, float("inf")), float("inf") if i is None else i)
    docs = []
    for (i, _, lang), t in zip(rows, texts):
        w = t.encode().split()
        fails = ""
        fails += "A" * (len(w) < 100)
        fails += "B" * (100 * len(set(w)) < 80 * len(w))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t))
        fails += "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * ((float("inf") if i is None else i) > earlier[t])
        good = any(q == 1 for d, q, _ in labels if d is not None and d == i)
        toxic = any(x == 1 for d, _, x in labels if d is not None and d == i)
        docs.append((lang or "", set(fails), good, toxic))
    out = []
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                before = sum(f in d[1] for d in own) - len(gone)
                left = [d for d in left if f not in d[1]]
                alone = sum(d[1] == {f} for d in own)
                shapley[f] += len(gone)
                lines.append(["".join(order), step, len(left), len(gone), before, alone, sum(d[2] for d in gone), sum(d[3] for d in gone)])
        out += [(part, *line, shapley[line[0][line[1] - 1]]) for line in lines]
    return sorted(out)


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "p", 2, 3, "d", 4) for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in audit_filters(docs.repartition(3), marks).collect())


def text(rng):
    kind = rng.randrange(4)
    n = rng.choice([0, 1, 99, 100, 101, 130])
    words = [f"w{rng.randrange(40 if kind == 1 else 10**6)}" for _ in range(n)]
    if kind == 2:
        words = [w.upper() + "ABC" for w in words]
    if kind == 3 and words:
        words[0] += rng.choice("#$%&*|")
    return rng.choice([" ", "\t", "\x0b "]).join(words)


def test_equals_plain_version(spark):
    rng = random.Random(5)
    rows = [(i, text(rng), rng.choice(["en", "de", "", None])) for i in range(120)]
    rows += [(500 + i, rows[rng.randrange(120)][1], rng.choice(["en", "fr"])) for i in range(60)]
    rows += [(700, None, "en"), (701, "", "en"), (None, None, None), (None, rows[3][1], "de"), (None, "only nameless", "de"), (None, "only nameless", "de")]
    rows += [(3, rows[3][1], "en"), (3, rows[3][1], "en"), (3, "other", "xx")]  # repeated ids
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 560, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99_999, 1, 1)]
    assert run(spark, rows, labels) == plain(rows, labels)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    rows = [(1, "a", "en"), (2, "a", "en")]
    assert run(spark, rows, []) == plain(rows, [])


def test_long_text_is_judged_whole():
    long = "aB " * 200_000 + "é" * 70_000 + " last$"
    masks = np.concatenate([text_masks(b) for b in blocks(pa.array([None, long, "x" * 99, ""]))])
    assert masks.tolist() == [1, 2 + 4 + 8, 1, 1]


def test_removal_ranks():
    rank = removal_ranks(np.arange(32))
    for mask in range(32):
        for o, order in enumerate(ORDERS):
            places = [s for s, f in enumerate(order) if mask >> f & 1]
            assert rank[mask, o] == (places[0] if places else 5)
