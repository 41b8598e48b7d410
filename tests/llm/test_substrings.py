import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from plain import documents, repeats_removed, sha256

from flowloom.llm.substrings import _group_repeats, _suffix_rows, drop_repeated_passages
from flowloom.llm.words import blocks


def corpus():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)] + ["über", "Öl", "x"]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 150))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(20) : rng.randrange(35, 60)]
        if i % 17 == 0:
            w += ["la"] * 70  # repeats inside one document
        rows.append((i * 3 - 5, "\t\n ".join(w) if i % 2 else " ".join(w)))
    rows += [(500 + i, rows[10 + i][1]) for i in range(12)]  # copies
    return rows


@pytest.fixture(scope="module")
def result(spark):
    rows = corpus()
    random.Random(2).shuffle(rows)
    df = documents(spark, [(i, t, "s") for i, t in rows]).repartition(5)
    return rows, {r["doc_id"]: r for r in drop_repeated_passages(df).collect()}


def test_equals_plain_version(result):
    rows, got = result
    rows = sorted(rows)
    want = repeats_removed([t for _, t in rows])
    assert len(got) == len(rows)
    for (i, _), w in zip(rows, want):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == w
    assert sum(w[1] for w in want) > 500


def test_removed_ranges_are_the_removed_words(result):
    for row in result[1].values():
        assert sum(b - a for a, b in row["removed"]) == row["n_removed"]


def test_many_copies_of_a_passage_between_random_words(spark):
    """A prefix that would overfill its group is lengthened; the result is the same."""
    rng = random.Random(3)
    line = [f"p{i}" for i in range(25)]
    rows = []
    for i in range(3000):
        around = [f"r{rng.randrange(10**9)}" for _ in range(30)]
        rows.append((i, " ".join(around[:15] + line + around[15:]), "s"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], sha256(r["kept_text"])) for r in drop_repeated_passages(documents(spark, rows).repartition(8)).collect()}
    want = repeats_removed([t for _, t, _ in rows])
    assert got == {i: (n, k, sha256(t)) for i, (n, k, t) in enumerate(want)}


def test_nulls_empty_repeated_ids_and_very_long(spark):
    w = " ".join(f"v{i}" for i in range(30))
    long = " ".join(f"u{i % 5000}" for i in range(60_000))
    rows = [(None, w, "s"), (1, w, "s"), (1, w, None), (2, None, "s"), (3, "", "s"), (4, " \n", "s"), (5, long, "s")]
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"], r["n_words"]) for r in drop_repeated_passages(documents(spark, rows)).collect()))
    # The null id comes first; the two rows with id 1 are copies of it.
    assert got == [(False, 0, 0, 30), (True, 1, 30, 30), (True, 1, 30, 30), (True, 2, 0, 0), (True, 3, 0, 0), (True, 4, 0, 0), (True, 5, 55_000, 60_000)]


def test_empty_table(spark):
    assert drop_repeated_passages(documents(spark, [])).count() == 0


def test_memory_of_a_group_stays_near_its_input():
    """A group of suffixes is spread out in parts, not at once."""
    rng = random.Random(7)
    texts = pa.array([" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(4000)])
    rows = [x for b in blocks(texts, block_bytes=4 << 20) for x in _suffix_rows(b, b.rows.astype(np.int64), 1, np.empty(0, np.uint64), 20, 8)]
    group = pa.Table.from_batches(rows)
    tracemalloc.start()
    marks = _group_repeats(group)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert marks.num_rows == 0
    assert peak < 4 * group.nbytes
