"""Counters over the last connections and near duplicates, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import near
from flowloom.operators.classes import linked_classes
from flowloom.operators.connections import SHARED, connection_counters
from flowloom.operators.near import near_duplicates, near_stars

FLOWS = "flow_id long, last_us long, src string, dst string, dport int, proto int, rank long, slice long"


def flows(n, seed, hosts=5):
    rng = random.Random(seed)
    pick = lambda name: rng.choice([f"{name}{i}" for i in range(hosts)] + [None])
    return [(i, rng.randrange(n // 3), pick("s"), pick("d"), rng.choice([53, 80]), rng.choice([6, 17]), 7, 8) for i in range(n)]


def plain_counters(rows, last):
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    names = FLOWS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    out = {}
    for at, row in enumerate(order):
        window = order[max(0, at + 1 - last) : at + 1]
        out[row[0]] = tuple(sum(all(w[names.index(c)] == row[names.index(c)] for c in cols) for w in window) for cols in SHARED.values())
    return out


@pytest.mark.parametrize("last, slice_rows", [(100, 20_000), (100, 64), (7, 5), (50, 10), (1, 3)])
def test_counters_equal_plain_version(spark, last, slice_rows):
    rows = flows(400, last)
    got = connection_counters(spark.createDataFrame(rows, FLOWS).repartition(3), last=last, slice_rows=slice_rows).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == plain_counters(rows, last)


def test_one_busy_key_is_spread_over_tasks(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("flow_id"), F.col("id").alias("last_us"), F.lit("a").alias("src"), F.lit("b").alias("dst"), F.lit(80).alias("dport"), F.lit(6).alias("proto")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = connection_counters(rows, slice_rows=500).withColumn("task", F.spark_partition_id())
        per_task = {r["task"]: r["count"] for r in found.groupBy("task").count().collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) >= 3 and max(per_task.values()) < 12_000
    assert found.where("ct_src_ltm <> least(flow_id + 1, 100)").isEmpty()


def test_no_flows(spark):
    assert connection_counters(spark.createDataFrame([], FLOWS)).count() == 0


def groups(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def plain_near(rows, eps):
    def apart(x, y):
        x, y = (math.nan if v is None else v for v in (x, y))
        if math.isnan(x) or math.isnan(y) or math.isinf(x) or math.isinf(y):
            return not (x == y or (math.isnan(x) and math.isnan(y)))
        return abs(round(x * 1e6) - round(y * 1e6)) > round(eps * 1e6)

    links = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if not any(apart(x, y) for x, y in zip(a[1:], b[1:]))]
    return groups([r[0] for r in rows], links)


def frame(spark, rows, d):
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"`x {i}` double" for i in range(d)))


@pytest.mark.parametrize("most", [5_000, 12, 3])
def test_near_duplicates_equal_plain_version(spark, monkeypatch, most):
    monkeypatch.setattr(near.near_links, "__defaults__", (most,))
    rng = random.Random(most)
    centres = [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(12)]
    rows = [(i, *[round(c + rng.choice([0, rng.gauss(0, 0.04)]), 3) for c in rng.choice(centres)]) for i in range(220)]
    rows += [(1000 + i, *rows[0][1:]) for i in range(30)]
    rows += [(2000, 0.05, 0.0, 0.0), (2001, 0.0, 0.0, 0.0), (2002, -0.05, 0.0, 0.0), (2003, 0.100001, 0.0, 0.0)]  # at the limit, and just beyond
    rows += [(3000, math.nan, 0.0, 0.0), (3001, math.nan, 0.01, 0.0), (3002, math.inf, 0.0, 0.0), (3003, -math.inf, 0.0, 0.0), (3004, 1e7, 0.0, 0.0)]
    got = near_duplicates(frame(spark, rows, 3).repartition(3), "key", ["x 0", "x 1", "x 2"], 0.05).collect()
    want = plain_near(rows, 0.05)
    assert {r["key"]: r["near_id"] for r in got} == want
    assert {r["key"]: r["copies"] for r in got}[1000] >= 31
    assert want[2000] == want[2002] and want[2003] != want[2000]


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [], 2), "key", ["x 0", "x 1"], 0.1).count() == 0
    assert [tuple(r) for r in near_duplicates(frame(spark, [(4, 1.0, None)], 2), "key", ["x 0", "x 1"], 0.1).collect()] == [(4, 4, 1)]


def test_stars_of_a_cell():
    points = np.array([[0, 0], [5, 1], [10, 0], [50, 0], [51, 9], [99, 99]])
    node, least = near_stars(points, np.array([7, 3, 9, 4, 8, 1]), 5)
    assert dict(zip(node.tolist(), least.tolist())) == {7: 3, 3: 3, 9: 3}


def test_classes_of_long_paths_stars_and_cycles(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    links += [(5000 + i, 5000 + (i + 1) % 40) for i in range(40)] + [(9, 9), (7000, 7001), (7001, 7000)]
    rng.shuffle(links)
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links]
    got = {r["node"]: r["class"] for r in linked_classes(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == groups({x for link in links for x in link}, links)
    assert linked_classes(spark.createDataFrame([], "a long, b long")).count() == 0
