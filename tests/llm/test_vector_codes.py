import hashlib
import math
import random

import numpy as np
import pytest

from flowloom.llm.vector_codes import CellCoder, box_candidates, compress_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, whole string, code long, part int, n long"


def frame(spark, rows):
    """(id, vector, label) with columns whose names clash with internal ones."""
    return spark.createDataFrame([(*r, "w", 1, 2, 3) for r in rows], SCHEMA)


def plain(rows, width):
    """The whole contract in Python integers: id -> (code, error), and the digest."""
    kept = []
    for i, v, label in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [max(-(1 << 24), min(1 << 24, math.floor(4096 * float(np.float32(x))))) for x in v]
        w += [0] * (8 * width - len(w))
        kept.append((i, label, [w[p * width : (p + 1) * width] for p in range(8)]))
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:16]
    books = [[r[2][p] for r in order] for p in range(8)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        new = []
        for p in range(8):
            own = [[] for _ in books[p]]
            for _, _, parts in kept:
                own[nearest(p, parts[p])[1]].append(parts[p])
            new.append([[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(own, books[p])])
        books = new
    out = []
    for i, label, parts in kept:
        found = [nearest(p, parts[p]) for p in range(8)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    totals = {}
    for _, label, _, error in out:
        totals[label] = totals.get(label, 0) + error
    text = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, c, e, totals[l], digest) for i, l, c, e in out), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_equals_plain_version(spark):
    rng = random.Random(3)
    rows = [(i * 3, [rng.gauss(0, 0.1) for _ in range(16)], rng.choice([1, 2, None])) for i in range(160)]
    rows += [(1000 + i, list(rows[0][1]), 2) for i in range(40)]  # copies: ties everywhere
    rows += [(7, None, 1), (8, [math.nan] * 16, 1), (10, [math.inf] + [0.0] * 15, None), (11, [None] + [0.0] * 15, 2)]
    rows += [(13, [0.0] * 16, 1), (13, [0.0] * 16, 1), (None, [0.5] * 16, None), (14, [1e9] + [-0.25] * 15, 1)]
    assert collected(compress_vectors(frame(spark, rows).repartition(3))) == plain(rows, 2)


def test_lengths_are_filled_with_zeros(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(rng.choice([0, 5, 9, 11]))], i % 2) for i in range(30)]
    assert collected(compress_vectors(frame(spark, rows))) == plain(rows, 2)


def test_few_vectors_and_empty_table(spark):
    rows = [(5, [0.1] * 8, 1), (2, [0.2] * 8, None)]
    assert collected(compress_vectors(frame(spark, rows))) == plain(rows, 1)
    assert compress_vectors(frame(spark, [])).count() == 0
    assert compress_vectors(frame(spark, [(1, None, 1)])).count() == 0


@pytest.mark.parametrize("shift", [0, 3, 6])
def test_cells_never_drop_the_nearest_entry(shift):
    rng = np.random.default_rng(shift)
    book = rng.integers(-100, 100, (16, 4))
    book[5] = book[3]  # a tie in every cell
    parts = rng.integers(-150, 150, (4000, 4))
    distance = ((parts[:, None] - book[None]) ** 2).sum(2)
    coder = CellCoder(book, shift)
    index, best = coder.nearest(parts)
    assert (index == distance.argmin(1)).all() and (best == distance.min(1)).all()
    masks = box_candidates((parts >> shift) << shift, 1 << shift, book)
    assert ((masks >> index) & 1).all()
    assert coder.measured < coder.asked * 0.8 and coder.cells


def test_memory_of_cells_is_bounded(monkeypatch):
    from flowloom.llm import vector_codes

    monkeypatch.setattr(vector_codes, "MOST_CELLS", 50)
    rng = np.random.default_rng(1)
    book, coder = rng.integers(0, 99, (16, 2)), None
    coder = CellCoder(book, 2)
    for _ in range(20):
        parts = rng.integers(0, 99, (40, 2))
        assert (coder.nearest(parts)[0] == ((parts[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
        assert len(coder.cells) <= 90
