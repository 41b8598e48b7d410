import math
import random

import pytest
from helpers import BASE, brute_features, brute_flows, frame, packet
from pyspark.sql import functions as F

from flowloom.functions.features import with_features
from flowloom.operators.flows import (
    BIDIRECTIONAL,
    OBSERVED,
    _sliced,
    fitting_slice_us,
    flag_histogram,
    flow_totals,
    native_sessions,
    packet_flows,
)
from flowloom.schemas import FEATURES

GAP = 2_000_000


def features(spark, rows, mode=OBSERVED, gap=GAP, slice_us=None):
    df = with_features(flow_totals(frame(spark, rows), gap, mode, slice_us), ["flow_id"])
    return {r["flow_id"]: r.asDict() for r in df.collect()}


def busy_packets(n, seed):
    """A third of all packets on one key, chatty and bursty, plus many small keys."""
    rnd = random.Random(seed)
    rows, clock = [], 0
    for i in range(n):
        clock += rnd.choice([0, 0, 10, 900, 400_000, 1_999_999, 2_000_000, 2_000_001, 5_000_000])
        at = clock // 12
        proto = rnd.choice([6, 6, 17, 1])
        if i % 3 == 0:
            a, b, proto = ("10.0.0.1", 4444), ("10.0.0.2", 80), 6
        else:
            a = (f"10.0.1.{rnd.randrange(4)}", rnd.choice([0, 53, 5000]))
            b = (f"10.0.1.{rnd.randrange(4)}", rnd.choice([0, 53, 80]))
        if rnd.random() < 0.4:
            a, b = b, a
        rows.append(
            packet(
                i, at, a[0], b[0], a[1], b[1], proto,
                pkt_len=rnd.randrange(40, 1600),
                payload_len=rnd.choice([0, 100, 4900]) if proto == 6 else 0,
                tcp_window=rnd.randrange(1, 70000) if proto == 6 else None,
                tcp_flags=rnd.choice([2, 16, 18, 24]) if proto == 6 else None,
                ip_version=6 if rnd.random() < 0.03 else 4,
            )
        )
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("mode", [OBSERVED, BIDIRECTIONAL])
@pytest.mark.parametrize("slice_us", [None, 700_000, 2_000_001, 10_000_000])
def test_features_equal_brute_force_for_any_slice(spark, mode, slice_us):
    rows = busy_packets(900, 7)
    want = {
        flow[0][0]["pkt_id"]: brute_features(flow)
        for flow in brute_flows(rows, GAP, mode == BIDIRECTIONAL)
    }
    got = features(spark, rows, mode, slice_us=slice_us)
    assert got.keys() == want.keys()
    for flow_id, expected in want.items():
        for name in FEATURES:
            assert math.isclose(got[flow_id][name], expected[name], rel_tol=1e-9, abs_tol=1e-9), (
                flow_id,
                name,
            )


@pytest.mark.parametrize("mode", [OBSERVED, BIDIRECTIONAL])
@pytest.mark.parametrize("slice_us", [None, 700_000, 3_000_000])
def test_packet_flows_equal_brute_force(spark, mode, slice_us):
    rows = busy_packets(600, 11)
    want = {}
    for flow in brute_flows(rows, GAP, mode == BIDIRECTIONAL):
        seen = {}
        for pos, (p, d) in enumerate(flow, 1):
            last, count = seen.get(d, (None, 0))
            gap = None if last is None else p["ts_us"] - last
            want[p["pkt_id"]] = (flow[0][0]["pkt_id"], flow[0][0]["ts_us"], d, pos, count + 1, gap)
            seen[d] = (p["ts_us"], count + 1)
    got = {
        r["pkt_id"]: (r["flow_id"], r["flow_us"], r["dir"], r["pos"], r["dir_pos"], r["gap_us"])
        for r in packet_flows(frame(spark, rows), GAP, mode, slice_us).collect()
    }
    assert got == want


@pytest.mark.parametrize("slice_us", [None, 700_000, 4_000_000])
def test_session_window_agrees(spark, slice_us):
    rows = busy_packets(600, 3)
    want = sorted(
        (f[0][0]["ts_us"], f[-1][0]["ts_us"], len(f), sum(p["pkt_len"] for p, _ in f))
        for f in brute_flows(rows, GAP, False)
    )
    got = sorted(
        (r["first_us"], r["last_us"], r["pkts"], r["bytes"])
        for r in native_sessions(frame(spark, rows), GAP, slice_us).collect()
    )
    assert got == want


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_partition_count_does_not_change_bits(spark, partitions):
    rows = busy_packets(400, 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = features(spark, rows, BIDIRECTIONAL, slice_us=1_000_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == features(spark, rows, BIDIRECTIONAL)


def test_single_packet(spark):
    (f,) = features(spark, [packet(1, 0)]).values()
    assert f["dur"] == 0.001
    assert f["Sjit"] == 0.0
    assert f["Sintpkt"] == pytest.approx(math.log1p(1e-4))


def test_gap_is_strict(spark):
    assert len(features(spark, [packet(1, 0), packet(2, GAP)])) == 1
    assert len(features(spark, [packet(1, 0), packet(2, GAP + 1)])) == 2


def test_chatty_flow_never_closes(spark):
    rows = [packet(i, i * 1_900_000) for i in range(200)]
    (f,) = features(spark, rows).values()
    assert f["dur"] == pytest.approx(199 * 1.9)
    assert f["Sjit"] == 0.0


def test_two_packets_have_no_jitter(spark):
    (f,) = features(spark, [packet(1, 0), packet(2, 500_000)]).values()
    assert f["Sjit"] == 0.0
    assert f["Sintpkt"] == pytest.approx(math.log1p(0.5))


def test_three_uneven_packets_have_population_jitter(spark):
    (f,) = features(spark, [packet(1, 0), packet(2, 500_000), packet(3, 2_000_000)]).values()
    assert f["Sjit"] == pytest.approx(0.5)


def test_payload_is_capped_before_the_mean(spark):
    (f,) = features(spark, [packet(1, 0, payload_len=0), packet(2, 10, payload_len=4900)]).values()
    assert f["smeansz"] == pytest.approx(math.log1p(750))


def test_ports(spark):
    icmp = features(spark, [packet(1, 0, proto=1, sport=7, dport=9)])
    same = features(spark, [packet(1, 0, sport=53, dport=53)])
    assert icmp[1]["ct_srv_src"] == 0
    assert same[1]["ct_srv_src"] == 1


def test_window_mean_is_truncated(spark):
    (f,) = features(spark, [packet(1, 0, tcp_window=1), packet(2, 1, tcp_window=2)]).values()
    assert f["swin"] == 1


def test_equal_times_are_ordered_by_packet_id(spark):
    (f,) = features(spark, [packet(5, 0, tcp_seq=50), packet(4, 0, tcp_seq=40)]).values()
    assert (f["flow_id"], f["stcpb"]) == (4, 40)


def reply(i, at, **over):
    return packet(i, at, src="h2", dst="h1", sport=80, dport=1000, **over)


def test_request_and_reply_by_mode(spark):
    rows = [packet(1, 0), reply(2, 10), packet(3, 20), reply(4, 30)]
    observed = features(spark, rows)
    assert sorted(observed) == [1, 2]
    assert all(f["dbytes"] == 0 and f["ct_srv_dst"] == 1 for f in observed.values())
    both = features(spark, rows, BIDIRECTIONAL)
    assert sorted(both) == [1]
    assert both[1]["dbytes"] == 200
    assert both[1]["ct_srv_dst"] == 2


def test_handshake_uses_any_bit_tests(spark):
    rows = [packet(1, 0, tcp_flags=2), reply(2, 100_000, tcp_flags=18), packet(3, 200_000, tcp_flags=16)]
    (f,) = features(spark, rows, BIDIRECTIONAL).values()
    assert f["synack"] == pytest.approx(0.1)
    # A SYN-ACK also carries the ACK bit, so it already counts as the first reverse ACK.
    assert f["tcprtt"] == pytest.approx(0.1)
    rows[1] = reply(2, 100_000, tcp_flags=2)
    (f,) = features(spark, rows, BIDIRECTIONAL).values()
    assert f["synack"] == pytest.approx(0.1)
    assert f["tcprtt"] == 0.0


def test_reply_without_syn_gives_zero_times(spark):
    (f,) = features(spark, [packet(1, 0), reply(2, 100, tcp_flags=18)], BIDIRECTIONAL).values()
    assert (f["tcprtt"], f["synack"]) == (0.0, 0.0)


def test_orientation_follows_the_first_packet(spark):
    rows = [reply(1, 0), packet(2, 10)]
    df = flow_totals(frame(spark, rows), GAP, BIDIRECTIONAL).collect()
    assert [(r["src"], r["sport"], r["dst"], r["dport"]) for r in df] == [("h2", 80, "h1", 1000)]


def test_non_ip_and_ipv6_are_dropped(spark):
    rows = [packet(1, 0), packet(2, 0, ip_version=6), packet(3, 0, src=None)]
    assert sorted(features(spark, rows)) == [1]


def test_packets_are_conserved(spark):
    rows = busy_packets(300, 9)
    kept = sum(1 for r in rows if r["ip_version"] == 4)
    total = flow_totals(frame(spark, rows), GAP).groupBy().sum("pkts").first()[0]
    assert total == kept


def test_flag_histogram(spark):
    rows = [packet(1, 0, tcp_flags=2), packet(2, 5, tcp_flags=16), packet(3, 9, tcp_flags=16)]
    got = {(r["flow_id"], r["tcp_flags"]): r["packets"] for r in flag_histogram(frame(spark, rows)).collect()}
    assert got == {(1, 2): 1, (1, 16): 2}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def test_flagship_plan_has_two_exchanges_and_no_lists(spark):
    df = with_features(flow_totals(frame(spark, [packet(1, 0)])), ["flow_id"])
    count, plan = exchanges(df)
    assert count == 2
    assert "collect_list" not in plan and "CartesianProduct" not in plan


def test_a_busy_key_is_spread_over_tasks(spark):
    """One key holds all packets, yet no shuffle partition gets a large share of them."""
    rows = [packet(i, i * 100_000) for i in range(8000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sliced = _sliced(frame(spark, rows), GAP, OBSERVED, 4_000_000)
        parts = sliced.select(F.spark_partition_id().alias("p"), "frag_us").groupBy("p")
        sizes = [r["n"] for r in parts.agg(F.count("frag_us").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert len(sizes) > 12 and max(sizes) < len(rows) / 5


def test_slices_shrink_until_they_fit(spark):
    rows = [packet(i, i * 1000) for i in range(2000)] + [packet(9000, 0, src="h9")]
    df = frame(spark, rows)
    assert fitting_slice_us(df, GAP) == 32_000_000
    for most in (1500, 100):
        slice_us = fitting_slice_us(df, GAP, most=most)
        times = [r["ts_us"] // slice_us for r in rows if r["src"] == "h1"]
        assert slice_us < 32_000_000 and max(times.count(t) for t in set(times)) <= most


def test_base_is_aligned():
    assert BASE % 1_000_000 == 0
