"""The stored vector index: exact against ``top_k``, pruned, appended to, and its probes."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import index as module
from flowloom.operators.index import (
    append_to_index,
    build_index,
    load_index,
    probe_search,
    pruned_search,
    recall_by_probes,
    search_plan,
    unindexable,
)
from flowloom.operators.retrieval import top_k
from flowloom.session import open_folder, shared_dir, work_path

ROWS = "doc_pos long, embedding array<double>, list string"


def clustered(spark, n=1500, groups=25, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    v = centres[rng.integers(0, groups, n)] + rng.normal(scale=0.12, size=(n, dim))
    v /= np.sqrt((v * v).sum(axis=1))[:, None]
    v[n // 2 : n // 2 + 40] = v[0]  # ties
    return spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(v)], ROWS)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_pos"], r["score"]) for r in df.collect())


def asked(corpus):
    return corpus.select(F.col("doc_pos").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def corpus(spark):
    return clustered(spark).cache()


@pytest.fixture(scope="module")
def index(spark, corpus):
    return build_index(corpus, work_path(spark, "test-index"), lists=30)


@pytest.mark.parametrize("skip_self", [False, True])
def test_exact_search_equals_a_full_scan(corpus, index, skip_self):
    assert rows(pruned_search(asked(corpus), index, 5, skip_self)) == rows(top_k(asked(corpus), corpus, 5, skip_self))


def test_most_pairs_are_never_multiplied(spark, corpus, index):
    _, first, rest = search_plan(asked(corpus), index, 5, True)
    sizes = spark.createDataFrame(list(enumerate(index.size.tolist())), "list int, n long")
    pairs = sum(x.join(sizes, "list").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (first, rest))
    assert pairs < 0.5 * corpus.count() ** 2
    assert first.join(rest, ["query_id", "list"]).isEmpty()


def test_only_wanted_lists_are_read(spark, index):
    plan = index.lists(spark, [1, 3])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "list#" in plan.split("PartitionFilters")[1].split("]")[0]
    files = index.lists(spark, [1, 3]).select(F.input_file_name()).distinct().collect()
    assert files and all("/list=1/" in f[0] or "/list=3/" in f[0] for f in files)


def test_append_and_load(spark, corpus):
    path = work_path(spark, "test-index")
    build_index(corpus.where("doc_pos < 900"), path, lists=12)
    before = {r[0] for r in load_index(spark, path).lists(spark).select(F.input_file_name()).distinct().collect()}
    index = append_to_index(load_index(spark, path), corpus.where("doc_pos >= 900"))
    after = {r[0] for r in index.lists(spark).select(F.input_file_name()).distinct().collect()}
    assert before < after  # nothing is written again
    assert index.size.sum() == corpus.count()
    again = load_index(spark, path)
    assert (again.turn == index.turn).all() and again.probes == index.probes
    assert rows(pruned_search(asked(corpus), again)) == rows(top_k(asked(corpus), corpus))


def test_default_probes_find_nearly_all(corpus, index):
    got = {r["probes"]: r["recall"] for r in recall_by_probes(asked(corpus), index, [1, index.probes, 30], skip_self=True).collect()}
    assert got[index.probes] >= 0.95 and got[30] == 1.0 and index.probes < 15
    assert len(rows(probe_search(asked(corpus).where("query_id < 10"), index, 3))) == 30


def written_bytes(spark):
    folder = Path(open_folder(shared_dir(spark))[1])
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_searches_write_no_vectors_by_list(spark, corpus, index):
    """Every list for every query: what is written and moved grows with the queries, not with queries times lists."""
    before = written_bytes(spark)
    assert rows(probe_search(asked(corpus), index, 5, 30, True)) == rows(top_k(asked(corpus), corpus, 5, True))
    assert written_bytes(spark) - before < 4 * 8 * 12 * corpus.count()
    queries = module._asked(asked(corpus), index)
    assert module._search_lists(queries, index, 5, True, lambda v, _: np.ones((len(v), 30), bool)).count() == 5 * corpus.count()


def test_blocks_of_queries_and_lists_may_be_small(monkeypatch, corpus, index):
    want = rows(pruned_search(asked(corpus), index, 5, True))
    for name, value in {"MARKED_CELLS": 30 * 70, "LIST_BYTES": 8 * 12 * 9, "QUERIES_AT_ONCE": 11, "SCORE_CELLS": 80}.items():
        monkeypatch.setattr(module, name, value)
    assert rows(pruned_search(asked(corpus).where("query_id % 4 = 0"), index, 5, True)) == [r for r in want if r[0] % 4 == 0]


def test_vectors_of_any_length_are_bounded(spark):
    rng = random.Random(4)
    data = [(i, [rng.gauss(0, 1) * s for _ in range(4)], "x") for i in range(300) for s in [rng.choice([0.0, 0.01, 1.0, 30.0])]]
    corpus = spark.createDataFrame(data, ROWS)
    index = build_index(corpus, work_path(spark, "test-index"), lists=9)
    got, want = {}, {}
    for q, r, d, s in rows(pruned_search(asked(corpus), index, 4)):
        got.setdefault(q, []).append((d, round(s, 9)))
    for q, _, _ in data:
        score = [(-sum(a * b for a, b in zip(data[q][1], v)), d) for d, v, _ in data]
        want[q] = [(d, round(-s, 9)) for s, d in sorted(score)[:4]]
    assert {q: [s for _, s in v] for q, v in got.items()} == {q: [s for _, s in v] for q, v in want.items()}


def test_odd_vectors_are_listed(spark):
    data = [(i, [1.0, float(i)], "x") for i in range(9)]
    data += [(20, None, "x"), (21, [1.0], "x"), (22, [math.nan, 1.0], "x"), (23, [None, 1.0], "x"), (24, [], "x")]
    corpus = spark.createDataFrame(data, ROWS)
    index = build_index(corpus, work_path(spark, "test-index"))
    assert index.size.sum() == 9
    assert {r[0]: r[1] for r in unindexable(corpus, 2).collect()} == {20: "missing", 21: "length", 22: "not finite", 23: "not finite", 24: "length"}
    assert {r["query_id"] for r in pruned_search(asked(corpus), index).collect()} == set(range(9))


def test_nothing_to_index(spark):
    empty = spark.createDataFrame([], ROWS)
    index = build_index(empty, work_path(spark, "test-index"))
    assert pruned_search(asked(empty), index).count() == probe_search(asked(empty), index).count() == 0
    zeros = spark.createDataFrame([(1, [0.0, 0.0], "x"), (2, [0.0, 0.0], "x")], ROWS)
    index = build_index(zeros, work_path(spark, "test-index"))
    assert rows(pruned_search(asked(zeros), index, 1)) == [(1, 1, 1, 0.0), (2, 1, 1, 0.0)]


def test_folders_of_stores():
    assert open_folder("file:///a/b")[1] == open_folder("file:/a/b")[1] == open_folder("/a/b")[1] == "/a/b"
    assert open_folder("dbfs:/x/y")[1] == "/dbfs/x/y"
    with pytest.raises(ValueError, match="wasb"):
        open_folder("wasb://x/y")
