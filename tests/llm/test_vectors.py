import random

import numpy as np
import pytest
from plain import vector_links

from flowloom.llm import vector_dedup
from flowloom.llm.neighbours import nearest_neighbours
from flowloom.llm.vector_dedup import near_duplicate_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, near string, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, c, 1, "a", "b") for i, v, c in rows], SCHEMA)


def clustered(n, seed, dims=16, spread=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        centre = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 6))):
            v = (centre + spread * rng.normal(size=dims)) * rng.uniform(0.5, 2)
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(rng.integers(0, 3))))
    return rows


def odd_rows(first, good):
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15]
    return [(first + i, v, 1) for i, v in enumerate(bad)] + [(first + 20, good, None), (first + 21, good, 1), (first + 22, good, 1)]


def test_links_equal_plain_version(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rows = clustered(300, 1)
    hot = rows[0][1]
    rng = np.random.default_rng(2)
    rows += [(1000 + i, [float(x) for x in (np.array(hot) * (1 + 0.05 * rng.normal(size=16))).astype(np.float32)], 1) for i in range(80)]
    rows += odd_rows(2000, rows[5][1])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(table(spark, rows).repartition(4)).collect()}
    want = vector_links(rows)
    assert got.keys() == want.keys()
    found = sum(n for n, _, _ in got.values())
    total = sum(n for n, _ in want.values())
    assert found >= 0.98 * total
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_links_of_an_empty_table_and_of_unusable_rows(spark):
    assert near_duplicate_vectors(table(spark, [])).count() == 0
    got = near_duplicate_vectors(table(spark, odd_rows(0, [1.0] * 16)[:7])).collect()
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got)


def exact(rows, k=20):
    usable = [(i, np.array(v, np.float64)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in usable:
        if q % 20 == 0:
            scored = sorted(((-float(x @ y), i) for i, y in usable if i != q))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_neighbours_recall(spark):
    rows = clustered(3000, 3, dims=24, spread=0.4)
    rows += [(9000 + r[0], (r[1] or []) + [0.0] * 8 if r[1] and len(r[1]) == 16 else r[1], r[2]) for r in odd_rows(0, [0.5] * 16)]
    got = {}
    for r in nearest_neighbours(table(spark, rows).repartition(4)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(rows)
    assert got.keys() == want.keys()
    hits = 0
    vectors = {i: np.array(v, np.float64) for i, v, _ in rows if v and None not in v}
    for q, found in got.items():
        found.sort()
        assert [n for n, _, _ in found] == list(range(1, 21))
        assert all(i != q for _, i, _ in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(s == pytest.approx(float(vectors[q] @ vectors[i]), abs=1e-9) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.95 * 20 * len(want)


def test_few_vectors_give_all_candidates(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(4)], 0) for i in range(12)] + [(3, [1.0, 1.0, 1.0, 1.0], 0)]
    got = nearest_neighbours(table(spark, rows)).collect()
    assert sorted(r["vec_id"] for r in got) == sorted([*range(1, 12), 3])  # every row is a candidate
    assert nearest_neighbours(table(spark, [])).count() == 0
    assert nearest_neighbours(table(spark, rows[:1])).count() == 0


def test_equal_vectors_rank_by_id(spark):
    rows = clustered(400, 5, dims=24, spread=0.4)
    large = max(rows, key=lambda r: float(np.linalg.norm(r[1])))[1]
    rows += [(1000 + i, large, 0) for i in range(700)] + [(3000 + i, rows[7][1], 1) for i in range(5)]
    got = {}
    for r in nearest_neighbours(table(spark, rows).repartition(4)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {q: [i for i, _ in found] for q, found in exact(rows).items()}
    assert got.keys() == want.keys()
    group = [q for q in want if 1000 <= q < 1700]
    assert [got[q] for q in group] == [want[q] for q in group]
    assert sum(len({*got[q]} & {*want[q]}) for q in want) >= 0.95 * 20 * len(want)


def test_recall_inside_a_dense_group(spark):
    rng = np.random.default_rng(8)
    rows = clustered(2500, 9, dims=64, spread=0.4)
    centre = np.array(rows[0][1])
    rows += [(10_000 + i, [float(x) for x in (centre * (1 + 0.02 * rng.normal(size=64))).astype(np.float32)], 0) for i in range(500)]
    got = {}
    for r in nearest_neighbours(table(spark, rows).repartition(4)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(rows)
    dense = [q for q in want if q >= 10_000]
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in dense) >= 0.95 * 20 * len(dense)
    others = [q for q in want if q < 10_000]
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in others) >= 0.95 * 20 * len(others)


def test_other_lengths_and_repeated_ids_take_part(spark):
    rows = clustered(60, 10) + [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1), (102, [2.0, 1.0], 1), (100, [1.0, 2.1], 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(table(spark, rows[:-1])).collect()}
    assert got[100] == got[101] == (1, 100) and got[102] == (0, 102)
    found = [tuple(r) for r in nearest_neighbours(table(spark, rows)).where("query_id = 100").collect()]
    assert sorted(i for _, _, i, _ in found) == [100, 100, 101, 101, 102, 102]  # each of both asks for all others
    assert sorted(rank for _, rank, _, _ in found) == [1, 1, 2, 2, 3, 3]
