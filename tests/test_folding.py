"""A stream that folds packets into open flows, against the batch result."""

import random

import pytest
from helpers import frame, packet
from pyspark.sql import functions as F
from test_flows import GAP, busy_packets

from flowloom.operators.flows import BIDIRECTIONAL, OBSERVED, flow_totals
from flowloom.plans.replay import CLOSING_SRC, add_closing_packets
from flowloom.schemas import PACKET_SCHEMA
from flowloom.sources.packets import stream_packets
from flowloom.streaming.folding import folded_flows_stream
from flowloom.streaming.late import correct_flows, corrected


def rows(df):
    return sorted(map(tuple, df.collect()))


def staged(spark, tmp_path, batches, closing=True):
    """One file per batch, in this order."""
    path = str(tmp_path / "packets")
    for batch in batches:
        frame(spark, batch).coalesce(1).write.mode("append").parquet(path)
    if closing:
        add_closing_packets(frame(spark, batches[0]), path)
    return path


def run(spark, tmp_path, path, delay, mode=OBSERVED, slice_us=None, name="a"):
    out, late, state = (str(tmp_path / f"{name}-{n}") for n in ("out", "late", "state"))
    folded_flows_stream(stream_packets(spark, path, 1), out, late, state, str(tmp_path / f"{name}-ck"), delay, GAP, mode, slice_us).awaitTermination()
    return spark.read.parquet(out).where(F.col("src") != CLOSING_SRC), spark.read.schema(PACKET_SCHEMA).option("recursiveFileLookup", True).parquet(late), state


def in_order(packets, n, shuffle=0):
    """``n`` batches; packets come up to ``shuffle`` microseconds out of order."""
    rng = random.Random(2)
    packets = sorted(packets, key=lambda p: p["ts_us"] + rng.randrange(shuffle + 1))
    size = -(-len(packets) // n)
    return [packets[i : i + size] for i in range(0, len(packets), size)]


@pytest.mark.parametrize("mode, slice_us, shuffle", [(OBSERVED, None, 0), (BIDIRECTIONAL, 900_000, 0), (BIDIRECTIONAL, None, 3_000_000)])
def test_folded_stream_equals_batch(spark, tmp_path, mode, slice_us, shuffle):
    packets = busy_packets(500, 41)
    path = staged(spark, tmp_path, in_order(packets, 4, shuffle))
    flows, late, _ = run(spark, tmp_path, path, shuffle + 1, mode, slice_us)
    want = flow_totals(frame(spark, packets), GAP, mode)
    assert late.isEmpty()
    assert rows(flows.select(*want.columns)) == rows(want)


def test_a_burst_leaves_one_row(spark, tmp_path):
    burst = [packet(i, i * 1000) for i in range(2000)]
    path = staged(spark, tmp_path, [burst, [packet(9000, 2_000_000), packet(9001, 2_000_001, src="h7")]], closing=False)
    _, _, state = run(spark, tmp_path, path, 0)
    slot = f"{state}/slot=1"
    assert spark.read.parquet(f"{slot}/open").select("pkts").collect()[0][0] == 2001
    assert spark.read.parquet(f"{slot}/open").count() == 1
    assert spark.read.parquet(f"{slot}/held").count() == 1  # the newest packet is not past the watermark


def test_late_packets_correct_the_folded_flows(spark, tmp_path):
    rng = random.Random(6)
    packets = busy_packets(400, 43)
    batches = in_order(packets, 3)
    withheld = [p for p in batches[0] if rng.random() < 0.15]
    batches[0] = [p for p in batches[0] if p not in withheld]
    path = staged(spark, tmp_path, [*batches, withheld + batches[2][:5]])  # and some delivered twice
    flows, late, _ = run(spark, tmp_path, path, 1)
    assert {p["pkt_id"] for p in withheld} <= {r["pkt_id"] for r in late.collect()}
    on_time = frame(spark, [p for b in batches for p in b])
    retracted, added = correct_flows(flows, on_time, late, GAP)
    want = flow_totals(frame(spark, packets), GAP)
    assert rows(corrected(flows, retracted, added).select(*want.columns)) == rows(want)
