"""Hand-made packets and a plain-Python account of what a flow is."""

import math

from pyspark.sql import functions as F

from flowloom.schemas import PACKET_SCHEMA

BASE = 1_700_000_000_000_000


def packet(i, at_us, src="h1", dst="h2", sport=1000, dport=80, proto=6, **over):
    """One packet as a tuple in PACKET_SCHEMA order; TCP fields only for TCP."""
    tcp = proto == 6
    row = {
        "pkt_id": i,
        "ts_us": BASE + at_us,
        "ts": None,
        "ip_version": 4,
        "src": src,
        "dst": dst,
        "sport": sport,
        "dport": dport,
        "proto": proto,
        "pkt_len": 100,
        "payload_len": 60 if tcp else 0,
        "tcp_window": 512 if tcp else None,
        "tcp_seq": i * 10 if tcp else None,
        "tcp_flags": 16 if tcp else None,
        "ttl": 64,
    }
    row.update(over)
    return row


def frame(spark, rows):
    fields = [f for f in PACKET_SCHEMA.fields if f.name != "ts"]
    data = [tuple(r[f.name] for f in fields) for r in rows]
    schema = type(PACKET_SCHEMA)(fields)
    return (
        spark.createDataFrame(data, schema)
        .withColumn("ts", F.timestamp_micros("ts_us"))
        .select(*PACKET_SCHEMA.names)
    )


def brute_flows(rows, gap_us, bidirectional):
    """Flows by walking the packets in order with one open flow per key."""
    open_flows, done = {}, []
    for p in sorted(rows, key=lambda r: (r["ts_us"], r["pkt_id"])):
        if p["ip_version"] != 4 or p["src"] is None:
            continue
        here, there = (p["src"], p["sport"]), (p["dst"], p["dport"])
        if p["proto"] not in (6, 17):
            here, there = (p["src"], 0), (p["dst"], 0)
        key = (here, there, p["proto"])
        if bidirectional:
            key = (*sorted([here, there]), p["proto"])
        flow = open_flows.get(key)
        if flow is None or p["ts_us"] - flow[-1][0]["ts_us"] > gap_us:
            if flow is not None:
                done.append(flow)
            flow = open_flows[key] = []
        first = flow[0][0] if flow else p
        forward = (p["src"], p["dst"]) == (first["src"], first["dst"])
        flow.append((p, "s" if forward else "d"))
    return done + list(open_flows.values())


def brute_features(flow):
    """The 18 features of one flow, from their definitions."""
    packets = [p for p, _ in flow]
    first = packets[0]
    by_dir = {d: [p for p, e in flow if e == d] for d in "sd"}

    def mean(xs):
        return sum(xs) / len(xs) if xs else 0.0

    def gaps(d):
        ts = [p["ts_us"] for p in by_dir[d]]
        return [(b - a) / 1e6 for a, b in zip(ts, ts[1:])]

    def spread(xs):
        if len(xs) < 2:
            return 0.0
        m = mean(xs)
        return math.sqrt(sum((x - m) ** 2 for x in xs) / len(xs))

    def first_time(d, bits):
        hits = [p["ts_us"] for p in by_dir[d] if p["tcp_flags"] is not None and p["tcp_flags"] & bits]
        return hits[0] if hits else None

    def later(a, b):
        return 0.0 if a is None or b is None else max(0.0, (b - a) / 1e6)

    dur = max(0.001, (packets[-1]["ts_us"] - packets[0]["ts_us"]) / 1e6)
    sbytes = sum(p["pkt_len"] for p in by_dir["s"])
    windows = [p["tcp_window"] for p in by_dir["s"] if p["tcp_window"] is not None]
    seqs = {d: [p["tcp_seq"] for p in by_dir[d] if p["tcp_seq"] is not None] for d in "sd"}
    syn = first_time("s", 0x02)
    has_ports = first["proto"] in (6, 17)
    ports = {first["sport"], first["dport"]} - {0} if has_ports else set()
    return {
        "dur": dur,
        "sbytes": sbytes,
        "dbytes": sum(p["pkt_len"] for p in by_dir["d"]),
        "Sload": math.log1p(sbytes / dur),
        "swin": int(mean(windows)),
        "stcpb": seqs["s"][0] if seqs["s"] else 0,
        "smeansz": math.log1p(mean([min(p["payload_len"], 1500) for p in packets])),
        "Sjit": spread(gaps("s")),
        "Djit": spread(gaps("d")),
        "Stime": math.log1p(dur),
        "Sintpkt": math.log1p(max(mean(gaps("s")), 1e-4)),
        "tcprtt": later(syn, first_time("d", 0x10)),
        "synack": later(syn, first_time("d", 0x12)),
        "ct_srv_src": len(ports),
        "ct_srv_dst": max(1, len(seqs["d"])),
        "ct_dst_ltm": 1,
        "ct_src_ ltm": 1,
        "ct_dst_src_ltm": 1,
    }
