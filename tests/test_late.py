"""Late packets and repeated attempts, against the batch result."""

import random

import pytest
from helpers import brute_flows, frame, packet
from pyspark.sql import functions as F
from test_flows import GAP, busy_packets

from flowloom.operators.flows import BIDIRECTIONAL, OBSERVED, flow_totals
from flowloom.schemas import PACKET_SCHEMA
from flowloom.sources.packets import stream_packets
from flowloom.streaming.late import correct_flows, corrected, split_late
from flowloom.streaming.retry import WAITING, drain, retries, score_with_retries


def rows(df):
    return sorted(map(tuple, df.collect()))


def ids(spark, path):
    return sorted(r["pkt_id"] for r in spark.read.schema(PACKET_SCHEMA).option("recursiveFileLookup", True).parquet(path).collect())


@pytest.mark.parametrize("mode", [OBSERVED, BIDIRECTIONAL])
def test_corrected_flows_equal_batch(spark, mode):
    rng = random.Random(5)
    everything = busy_packets(500, 31)
    late = [p for p in everything if rng.random() < 0.1]
    on_time = [p for p in everything if p not in late]
    packets = frame(spark, on_time)
    flows = flow_totals(packets, GAP, mode)
    # Late packets delivered twice, and one that was counted long ago.
    retracted, added = correct_flows(flows, packets, frame(spark, late + late[:20] + on_time[:3]), GAP, mode)
    want = flow_totals(frame(spark, everything), GAP, mode)
    assert rows(corrected(flows, retracted, added).select(*want.columns)) == rows(want)
    assert len(brute_flows(everything, GAP, mode == BIDIRECTIONAL)) == want.count()


def test_a_late_packet_bridges_two_flows_and_leaves_others_alone(spark):
    step = GAP * 3 // 2
    on_time = [packet(1, 0), packet(2, step), packet(3, 10 * GAP), packet(4, 0, src="h9")]
    packets = frame(spark, on_time)
    flows = flow_totals(packets, GAP)
    assert flows.count() == 4
    retracted, added = correct_flows(flows, packets, frame(spark, [packet(7, step // 2), packet(8, 50 * GAP, src="h5")]), GAP)
    assert sorted(r[0] for r in retracted.collect()) == [1, 2]
    assert sorted((r["flow_id"], r["pkts"]) for r in added.collect()) == [(1, 3), (8, 1)]
    assert sorted(r["flow_id"] for r in corrected(flows, retracted, added).collect()) == [1, 3, 4, 8]


def test_no_late_packets_change_nothing(spark):
    packets = frame(spark, busy_packets(80, 3))
    flows = flow_totals(packets, GAP)
    retracted, added = correct_flows(flows, packets, packets.limit(0), GAP)
    assert retracted.isEmpty() and added.isEmpty()


def test_late_packets_are_set_aside_and_a_replay_repeats_it(spark, tmp_path):
    path = str(tmp_path / "raw")
    for batch in ([packet(1, 0), packet(2, 9_000_000)], [packet(3, 1_000_000), packet(4, 8_500_000)], [packet(5, 20_000_000), packet(3, 1_000_000)], [packet(6, 9_000_000)]):
        frame(spark, batch).coalesce(1).write.mode("append").parquet(path)
    accepted, late, state = (str(tmp_path / n) for n in ("accepted", "late", "state"))
    for attempt in range(2):  # the second run has lost its checkpoint
        split_late(stream_packets(spark, path, 1), accepted, late, state, str(tmp_path / f"ck{attempt}"), 1_000_000).awaitTermination()
        assert ids(spark, accepted) == [1, 2, 4, 5]
        assert ids(spark, late) == [3, 3, 6]


def score(rows):
    bad = (F.col("row_id") % 4 == 0) & (F.col("attempt") <= F.col("row_id") % 7)
    return rows.withColumn("score_status", F.when(bad, "error").otherwise("ok"))


def test_every_record_ends_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(60).select(F.col("id").alias("row_id"), F.lit("x").alias("line")).repartition(3).write.parquet(source)
    results, dead, retry = (str(tmp_path / n) for n in ("results", "dead", "retry"))
    stream = spark.readStream.schema("row_id long, line string").option("maxFilesPerTrigger", 1).parquet(source)
    score_with_retries(stream, score, results, dead, retry, str(tmp_path / "ck"), "stream", attempts=4).awaitTermination()
    runs = drain(spark, score, results, dead, retry, str(tmp_path / "ck2"), attempts=4)
    assert runs <= 5
    read = spark.read.option("recursiveFileLookup", True)
    found = {r["row_id"]: r["attempt"] for r in read.parquet(results).collect()}
    gone = [r["row_id"] for r in read.parquet(dead).collect()]
    assert read.parquet(results).count() == len(found) and len(set(gone)) == len(gone)
    assert found.keys() | set(gone) == set(range(60)) and not found.keys() & set(gone)
    assert all(i % 4 == 0 and i % 7 >= 4 for i in gone)
    assert all(found[i] == (1 if i % 4 else i % 7 + 1) for i in found)


def test_a_record_waits_until_it_is_due(spark, tmp_path):
    retry, results, dead = (str(tmp_path / n) for n in ("retry", "results", "dead"))
    soon = [(1, "x", 2, None), (2, "x", 2, __import__("datetime").datetime(2200, 1, 1))]
    spark.createDataFrame(soon, WAITING).coalesce(1).write.parquet(f"{retry}/source=stream/batch_id=0")
    query = score_with_retries(retries(spark, retry), lambda r: r.withColumn("score_status", F.lit("ok")), results, dead, retry, str(tmp_path / "ck"), "retry")
    query.awaitTermination()
    read = spark.read.option("recursiveFileLookup", True)
    assert [r["row_id"] for r in read.parquet(results).collect()] == [1]
    waiting = read.schema(WAITING).parquet(f"{retry}/source=retry").collect()
    assert {(r["row_id"], r["attempt"]) for r in waiting} == {(2, 2)}
