"""Tables laid out by key, updates that touch few files, and tree ensembles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import keys, tables
from flowloom.operators.trees import Forest, Tree, TreeScorer
from flowloom.schemas import FEATURES, LABELS, quoted
from flowloom.session import work_path


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


@pytest.fixture(scope="module")
def ranges(spark):
    path = work_path(spark, "ranges")
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(1000)) if i % 50 else None) for i in range(4000)] + [(10_000 + i, 77.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k double")
    tables.write_ranges(df, path, "k", ("id",), parts=12)
    return path, rows


@pytest.mark.parametrize("low, high", [(100.0, 140.0), (77.0, 77.0), (None, 20.0), (990.0, None), (2000.0, 3000.0), (5.0, 4.0), (None, None)])
def test_ranges_are_complete(spark, ranges, low, high):
    path, rows = ranges
    got = sorted(r["id"] for r in tables.read_range(spark, path, "k", low, high).collect())
    inside = [i for i, k in rows if (low is None and high is None) or (k is not None and (low is None or k >= low) and (high is None or k <= high))]
    assert got == sorted(inside)


def test_a_range_opens_few_files(spark, ranges):
    path, _ = ranges
    part = tables.read_range(spark, path, "k", 300.0, 340.0)
    assert len(files(part)) <= 2 < len(files(spark.read.parquet(f"{path}/rows")))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters" in plan
    hot = spark.read.parquet(f"{path}/rows").where("k = 77").select("part").distinct().count()
    assert hot >= 2  # a key of a third of all rows is spread


def test_bucketed_tables_join_without_an_exchange(spark):
    left = spark.range(3000).select((F.col("id") % 700).alias("k"), "id")
    right = spark.range(200).select((F.col("id") * 5).alias("k"), F.lit("x").alias("v"))
    a, b = (spark.table(tables.write_bucketed(df, work_path(spark, "bucketed"), "k", 8)) for df in (left, right))
    joined = keys.lookup_many(a, b, "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keys.lookup_many(a, b, "k")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" in plan
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells
        assert "SelectedBucketsCount: 1 out of 8" in keys.lookup(a, "k", 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert sorted(r["id"] for r in joined.collect()) == [i for i in range(3000) if (i % 700) % 5 == 0 and i % 700 < 1000]


def stored_table(spark, n=500):
    path = work_path(spark, "buckets")
    tables.write_buckets(spark.range(n).select(F.col("id").alias("key"), F.lit("old").alias("v")), path, "key", 16)
    return path


def test_upsert_touches_only_its_buckets(spark):
    path = stored_table(spark)
    before = files(spark.read.parquet(path))
    changes = spark.createDataFrame([(3, "new"), (4, "new"), (900, "added")], "key long, v string")
    touched = tables.upsert_buckets(spark, path, "key", changes, 16)
    assert 1 <= len(touched) <= 3
    got = {r["key"]: r["v"] for r in tables.read_buckets(spark, path).collect()}
    assert got == {i: "old" for i in range(500)} | {3: "new", 4: "new", 900: "added"}
    after = files(spark.read.parquet(path))
    other = {f for f in before if int(f.split("/bucket=")[1].split("/")[0]) not in touched}
    assert other <= after and len(other) >= 13


def test_delete_and_empty_buckets(spark):
    path = stored_table(spark, 40)
    gone = spark.range(40).select(F.col("id").alias("key")).where("key <> 7").union(spark.createDataFrame([(None,), (7000,)], "key long"))
    tables.delete_from_buckets(spark, path, "key", gone, 16)
    assert [tuple(r) for r in tables.read_buckets(spark, path).collect()] == [(7, "old")]
    assert tables.delete_from_buckets(spark, path, "key", gone.limit(0), 16) == []
    assert tables.upsert_buckets(spark, path, "key", spark.createDataFrame([], "key long, v string"), 16) == []


def grown(rng, label, depth):
    """A random tree as nested tuples and as flat arrays."""
    feature, threshold, left, right, missing, value = [], [], [], [], [], []

    def add(d):
        at = len(feature)
        leaf = d == 0 or rng.random() < 0.2
        for column, x in ((feature, -1 if leaf else rng.randrange(len(FEATURES))), (threshold, rng.choice([-0.5, 0.0, 0.25])), (left, 0), (right, 0), (missing, rng.random() < 0.5), (value, rng.uniform(-1, 1))):
            column.append(x)
        if not leaf:
            left[at], right[at] = add(d - 1), add(d - 1)
        return at

    add(depth)
    return Tree(label, feature, threshold, left, right, missing, value)


def reached(tree, row):
    at = 0
    while tree.feature[at] >= 0:
        x = row[tree.feature[at]]
        go_left = tree.missing_left[at] if x is None or math.isnan(x) else x < tree.threshold[at]
        at = (tree.left if go_left else tree.right)[at]
    return tree.value[at]


def test_trees_walk_like_a_plain_walk(spark):
    rng = random.Random(3)
    trees = [grown(rng, t % len(LABELS), rng.randrange(0, 5)) for t in range(40)]
    rows = [[rng.choice([None, math.nan, 0.0, 0.25, -0.5, rng.gauss(0, 1), math.inf]) for _ in FEATURES] for _ in range(120)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{quoted(f)} double" for f in FEATURES))
    base = [0.1 * c for c in range(len(LABELS))]
    got = {r["id"]: r["probs"] for r in TreeScorer(trees, base)(df.repartition(3)).collect()}
    for i, row in enumerate(rows):
        margins = [b + sum(reached(t, row) for t in trees if t.label == c) for c, b in enumerate(base)]
        powers = [math.exp(m) for m in margins]
        assert got[i] == pytest.approx([p / sum(powers) for p in powers], abs=1e-12)


def test_forest_of_nothing():
    assert (Forest([], 3).margins(np.zeros((2, 4))) == 0).all()
