"""Packets -> flows.

A flow is a run of packets with one key and no idle gap above ``gap_us``.  A busy
key may hold a large share of all packets, so no task ever sees a whole key:

1. Packets are shuffled by (key, time slice).  Inside a slice, gaps split them
   into *fragments*, and each fragment is reduced to a few integers.
2. Only a fragment lying within one gap of its slice border can continue in the
   next slice; at most two per slice do.  Those are brought together per key,
   all others stay spread out by slice.  Neighbouring fragments are stitched
   and their totals added.

The second shuffle moves fragments, not packets, and a key contributes at most two
border fragments per slice of time, however many packets it has.  All totals
are integers (microseconds, bytes, counts), so results do not depend on slicing,
partitioning or row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.packets import (
    ACK,
    SYN,
    SYN_OR_ACK,
    ipv4_only,
    with_flow_key,
    with_tcp_fields,
)
from flowloom.schemas import DEFAULT_GAP_US, FLOW_KEY, MAX_PAYLOAD
from flowloom.session import plan_bytes

OBSERVED, BIDIRECTIONAL = "observed", "bidirectional"

MAX_LONG = (1 << 63) - 1
MOST_PACKETS = 20_000_000  # of one key in one slice, which one task sorts
SAMPLE = 64  # one packet of so many is counted to find bursting keys

KEY = ["a", "a_port", "b", "b_port", "proto"]
SLICE = [*KEY, "slice_us"]
HANDSHAKE = {"syn": SYN, "synack": SYN_OR_ACK, "ack": ACK}

SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def default_slice_us(gap_us: int) -> int:
    """Sixteen gaps: long enough to reduce well, short enough to split a busy key."""
    return max(1, 16 * gap_us)


def fitting_slice_us(
    packets: DataFrame, gap_us: int = DEFAULT_GAP_US, mode: str = OBSERVED, most: int = MOST_PACKETS
) -> int:
    """The widest slice, from the default downwards, holding about ``most`` packets per key at most.

    A table of fewer bytes than that has no such slice and is not looked at.  Otherwise one
    pass counts a sample of the packets, pre-aggregated in each task, and every further pass,
    needed only where a key bursts, tries a sixteenth.  Results never depend on the slice,
    only task sizes do.
    """
    slice_us = default_slice_us(gap_us)
    return slice_us if plan_bytes(packets) < most else _fitting(_keyed(packets, mode), KEY, slice_us, most)


def _fitting(packets: DataFrame, keys: list[str], slice_us: int, most: int) -> int:
    """The widest of ``slice_us`` and its sixteenths with at most about ``most`` packets per key and slice."""
    keyed = packets.where(F.pmod(F.xxhash64("pkt_id"), F.lit(SAMPLE)) == 0)
    while slice_us > 1:
        parts = keyed.selectExpr(*keys, f"ts_us - pmod(ts_us, {slice_us}L) AS slice_us").groupBy(*keys, "slice_us").count()
        if SAMPLE * (parts.agg(F.max("count")).first()[0] or 0) <= most:
            break
        slice_us = max(1, slice_us // 16)
    return slice_us


def _over(keys: list[str], order: str, rows: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(keys)} ORDER BY {order} {rows})"


def _directions(mode: str) -> dict[str, str]:
    """Packet directions relative to the grouping key; 'f' leaves endpoint a."""
    if mode == OBSERVED:
        return {"f": "true"}
    if mode == BIDIRECTIONAL:
        return {"f": "fwd", "r": "NOT fwd"}
    raise ValueError(f"unknown flow mode: {mode!r}")


def _keyed(packets: DataFrame, mode: str) -> DataFrame:
    """Add the grouping key, ``fwd`` (address order) and ``orient`` (endpoint order).

    Observed mode groups by the directional 5-tuple.  Bidirectional mode groups both
    directions under the ordered pair of endpoints.  Direction compares addresses only,
    so traffic of a host with itself is all forward.
    """
    p = with_tcp_fields(with_flow_key(ipv4_only(packets)))
    if mode == OBSERVED:
        p = p.selectExpr("*", "true AS orient", "true AS fwd")
    else:
        p = p.selectExpr("*", "struct(src, sport) <= struct(dst, dport) AS orient", "src <= dst AS fwd")
    return p.selectExpr(
        "*",
        "if(orient, src, dst) AS a",
        "if(orient, sport, dport) AS a_port",
        "if(orient, dst, src) AS b",
        "if(orient, dport, sport) AS b_port",
    )


def _sliced(packets: DataFrame, gap_us: int, mode: str, slice_us: int) -> DataFrame:
    """Step 1: mark fragments inside each (key, slice)."""
    if slice_us < 1:
        raise ValueError("slice_us must be at least 1")
    order = "ts_us, pkt_id"
    so_far, before = _over(SLICE, order, SO_FAR), _over(SLICE, order, BEFORE)
    looks_back = []
    for d, cond in _directions(mode).items():
        earlier = "prev_us" if mode == OBSERVED else f"last(if({cond}, ts_us, NULL), true) {before}"
        looks_back += [
            f"{earlier} AS before_{d}",
            f"last(if({cond} AND tcp_seq IS NOT NULL, ts_us, NULL), true) {before} AS tcp_before_{d}",
        ]
    return (
        _keyed(packets, mode)
        .selectExpr("*", f"ts_us - pmod(ts_us, {slice_us}L) AS slice_us")
        .selectExpr("*", f"lag(ts_us) {_over(SLICE, order)} AS prev_us")
        .selectExpr("*", f"prev_us IS NULL OR ts_us - prev_us > {gap_us}L AS opens")
        .selectExpr("*", f"max(if(opens, ts_us, NULL)) {so_far} AS frag_us", *looks_back)
    )


def _within(name: str) -> str:
    """A looked-back time, null when it belongs to an earlier fragment."""
    return f"if({name} >= frag_us, {name}, NULL)"


def _gap(d: str, cond: str) -> str:
    return f"if({cond}, ts_us - {_within(f'before_{d}')}, NULL)"


def _on_open(column: str, name: str | None = None) -> str:
    return f"max(if(opens, {column}, NULL)) AS {name or column}"


def _fragments(sliced: DataFrame, mode: str, gap_us: int, slice_us: int) -> DataFrame:
    """Reduce every fragment to integers; same partitioning, so no shuffle."""
    directions = _directions(mode)
    # Gaps of a fragment sum to at most the slice and are at most the gap each (two directions
    # may each span the slice), which bounds the sum of their squares.
    fits = slice_us * max(gap_us, slice_us if mode == BIDIRECTIONAL else 0) <= MAX_LONG
    kind = "BIGINT" if fits else "DECIMAL(18,0)"
    gaps = [f"CAST({_gap(d, cond)} AS {kind}) AS gap_{d}" for d, cond in directions.items()]
    aggs = [
        "count(*) AS pkts",
        "max(ts_us) AS last_us",
        _on_open("pkt_id", "first_pkt"),
        f"sum(least(payload_len, {MAX_PAYLOAD}L)) AS payload_sum",
    ]
    if mode == BIDIRECTIONAL:
        aggs += [_on_open("fwd", "first_fwd"), _on_open("orient", "first_orient")]
    for d, cond in directions.items():
        first_tcp = f"{cond} AND {_within(f'tcp_before_{d}')} IS NULL"
        aggs += [
            f"sum(if({cond}, pkt_len, 0L)) AS bytes_{d}",
            f"count(if({cond}, 1, NULL)) AS pkts_{d}",
            f"min(if({cond}, ts_us, NULL)) AS first_us_{d}",
            f"max(if({cond}, ts_us, NULL)) AS last_us_{d}",
            f"sum(gap_{d} * gap_{d}) AS gap_sq_{d}",
            f"sum(if({cond}, tcp_window, NULL)) AS win_sum_{d}",
            f"count(if({cond}, tcp_window, NULL)) AS win_n_{d}",
            f"count(if({cond}, tcp_seq, NULL)) AS seq_n_{d}",
            f"max(if({first_tcp}, tcp_seq, NULL)) AS first_seq_{d}",
        ]
        if mode == BIDIRECTIONAL:
            aggs += [
                f"min(if({cond} AND tcp_flags & {bits} != 0, ts_us, NULL)) AS {name}_{d}"
                for name, bits in HANDSHAKE.items()
            ]
    return sliced.selectExpr("*", *gaps).groupBy(*SLICE, "frag_us").agg(*map(F.expr, aggs))


def _stitched(fragments: DataFrame, gap_us: int, slice_us: int, columns: list[str], since: int | None = None) -> DataFrame:
    """Step 2: continue flows across slice borders, giving every fragment its ``flow_us``.

    With ``since``, all fragments without a slice end before that time and all others begin then or later, in
    the middle of a slice perhaps.

    ``lane`` is null for border fragments, and for flows still open from an earlier batch,
    which have no slice; these meet per key.  For all others it is the slice itself.
    ``columns`` may use ``{before}`` and ``{so_far}``, the frames over earlier fragments.
    """
    keys = [*KEY, "lane"]
    frames = {"before": _over(keys, "frag_us", BEFORE), "so_far": _over(keys, "frag_us", SO_FAR)}
    inner = f"frag_us - slice_us >= {gap_us}L AND slice_us + {slice_us}L - last_us > {gap_us}L"
    if since is not None:
        inner += f" AND frag_us - {since}L >= {gap_us}L"
    return (
        fragments.selectExpr("*", f"if({inner}, slice_us, NULL) AS lane")
        .selectExpr("*", f"lag(last_us) {_over(keys, 'frag_us')} AS prev_us")
        .selectExpr("*", f"prev_us IS NULL OR frag_us - prev_us > {gap_us}L AS opens")
        .selectExpr(
            "*",
            f"max(if(opens, frag_us, NULL)) {frames['so_far']} AS flow_us",
            *[c.format(**frames) for c in columns],
        )
    )


def flow_totals(
    packets: DataFrame,
    gap_us: int = DEFAULT_GAP_US,
    mode: str = OBSERVED,
    slice_us: int | None = None,
) -> DataFrame:
    """One row per flow with integer totals, seen from the flow's first packet.

    ``s_`` columns describe the initiator's direction, ``d_`` columns the replies
    (always empty in observed mode).  ``flow_id`` is the id of the first packet.
    """
    slice_us = slice_us or fitting_slice_us(packets, gap_us, mode)
    fragments = fragment_totals(packets, gap_us, mode, slice_us)
    return oriented_totals(merge_fragments(fragments, gap_us, mode, slice_us), mode)


def fragment_totals(packets: DataFrame, gap_us: int, mode: str, slice_us: int) -> DataFrame:
    """Step 1 in one go: packets -> fragments."""
    return _fragments(_sliced(packets, gap_us, mode, slice_us), mode, gap_us, slice_us)


def merge_fragments(fragments: DataFrame, gap_us: int, mode: str, slice_us: int, since: int | None = None) -> DataFrame:
    """Step 2 in one go: fragments -> flows, with the columns of a fragment.

    A merged flow can therefore be merged again with later fragments; ``slice_us`` is the
    last slice it reached.  ``since`` is the time at which an earlier merge ended, if not between slices.
    """
    directions = _directions(mode)
    looks_back = []
    for d in directions:
        looks_back += [
            f"last(last_us_{d}, true) {{before}} AS prev_{d}",
            f"last(if(first_seq_{d} IS NOT NULL, frag_us, NULL), true) {{before}} AS seen_{d}",
        ]
    aggs = [
        "sum(pkts) AS pkts",
        "max(last_us) AS last_us",
        _on_open("first_pkt"),
        "sum(payload_sum) AS payload_sum",
        "max(slice_us) AS slice_us",
    ]
    if mode == BIDIRECTIONAL:
        aggs += [_on_open("first_fwd"), _on_open("first_orient")]
    for d in directions:
        bridge = f"CAST(if(prev_{d} >= flow_us, first_us_{d} - prev_{d}, 0L) AS DECIMAL(18,0))"
        aggs += [
            f"sum(bytes_{d}) AS bytes_{d}",
            f"sum(pkts_{d}) AS pkts_{d}",
            f"min(first_us_{d}) AS first_us_{d}",
            f"max(last_us_{d}) AS last_us_{d}",
            f"sum(CAST(coalesce(gap_sq_{d}, 0) AS DECIMAL(38,0)) + coalesce({bridge} * {bridge}, 0)) AS gap_sq_{d}",
            f"sum(win_sum_{d}) AS win_sum_{d}",
            f"sum(win_n_{d}) AS win_n_{d}",
            f"sum(seq_n_{d}) AS seq_n_{d}",
            f"max(if(seen_{d} IS NULL OR seen_{d} < flow_us, first_seq_{d}, NULL)) AS first_seq_{d}",
        ]
        if mode == BIDIRECTIONAL:
            aggs += [f"min({name}_{d}) AS {name}_{d}" for name in HANDSHAKE]
    flows = _stitched(fragments, gap_us, slice_us, looks_back, since)
    flows = flows.groupBy(*KEY, "lane", "flow_us").agg(*map(F.expr, aggs)).drop("lane")
    return flows.withColumnRenamed("flow_us", "frag_us")


def oriented_totals(flows: DataFrame, mode: str) -> DataFrame:
    """Turn per-direction totals into initiator / responder totals."""
    one_way = mode == OBSERVED

    def side(name: str, of_source: bool) -> str:
        if one_way:
            return f"{name}_f" if of_source else "CAST(NULL AS BIGINT)"
        same, other = ("f", "r") if of_source else ("r", "f")
        return f"if(first_fwd, {name}_{same}, {name}_{other})"

    def endpoint(same: str, other: str) -> str:
        return same if one_way else f"if(first_orient, {same}, {other})"

    columns = [
        f"{endpoint('a', 'b')} AS src",
        f"{endpoint('a_port', 'b_port')} AS sport",
        f"{endpoint('b', 'a')} AS dst",
        f"{endpoint('b_port', 'a_port')} AS dport",
        "proto",
        "first_pkt AS flow_id",
        "frag_us AS first_us",
        "last_us",
        "pkts",
        "payload_sum",
    ]
    for prefix, of_source in (("s", True), ("d", False)):
        columns += [
            f"coalesce({side('bytes', of_source)}, 0L) AS {prefix}bytes",
            f"coalesce({side('pkts', of_source)}, 0L) AS {prefix}_pkts",
            f"greatest(coalesce({side('pkts', of_source)}, 0L) - 1L, 0L) AS {prefix}_gap_n",
            f"coalesce({side('last_us', of_source)} - {side('first_us', of_source)}, 0L) AS {prefix}_gap_sum",
            f"coalesce(CAST({side('gap_sq', of_source)} AS DECIMAL(38,0)), CAST(0 AS DECIMAL(38,0))) AS {prefix}_gap_sq",
            f"coalesce({side('win_sum', of_source)}, 0L) AS {prefix}_win_sum",
            f"coalesce({side('win_n', of_source)}, 0L) AS {prefix}_win_n",
            f"coalesce({side('seq_n', of_source)}, 0L) AS {prefix}_seq_n",
            f"{side('first_seq', of_source)} AS {prefix}_first_seq",
        ]
    for name in HANDSHAKE:
        value = "CAST(NULL AS BIGINT)" if one_way else side(name, name == "syn")
        columns.append(f"{value} AS {name}_us")
    return flows.selectExpr(*columns)


def packet_flows(
    packets: DataFrame,
    gap_us: int = DEFAULT_GAP_US,
    mode: str = OBSERVED,
    slice_us: int | None = None,
) -> DataFrame:
    """Every packet with its flow, direction, position and in-direction gap.

    This is the long form of per-flow ordered lists (A4): one row per list entry, in
    order of ``pos``, so a flow of any length stays spread over tasks.
    """
    slice_us = slice_us or fitting_slice_us(packets, gap_us, mode)
    directions = _directions(mode)
    sliced = _sliced(packets, gap_us, mode, slice_us)
    over, so_far = _over(SLICE, "ts_us, pkt_id"), _over(SLICE, "ts_us, pkt_id", SO_FAR)
    first = {"frag_pkt": "pkt_id", "frag_fwd": "fwd", "frag_n": "n - 1"}
    first |= {f"frag_n_{d}": f"n_{d} - CAST({cond} AS BIGINT)" for d, cond in directions.items()}
    marked = sliced.selectExpr(
        "*",
        f"CAST(row_number() {over} AS BIGINT) AS n",
        *[f"count(if({cond}, 1, NULL)) {so_far} AS n_{d}" for d, cond in directions.items()],
    ).selectExpr("*", *[f"last(if(opens, {v}, NULL), true) {so_far} AS {c}" for c, v in first.items()])

    aggs = ["count(*) AS pkts", "max(ts_us) AS last_us", _on_open("pkt_id", "first_pkt"), _on_open("fwd", "first_fwd")]
    for d, cond in directions.items():
        aggs += [f"count(if({cond}, 1, NULL)) AS pkts_{d}", f"max(if({cond}, ts_us, NULL)) AS last_us_{d}"]
    fragments = sliced.groupBy(*SLICE, "frag_us").agg(*map(F.expr, aggs))

    # Only border fragments can belong to a flow that began earlier.
    counts = {"skip": "pkts", **{f"skip_{d}": f"pkts_{d}" for d in directions}}
    looks_back = [f"coalesce(sum({c}) {{before}}, 0L) AS {s}" for s, c in counts.items()]
    looks_back += [f"last(last_us_{d}, true) {{before}} AS prev_{d}" for d in directions]
    opening = {"flow_pkt": "first_pkt", "flow_fwd": "first_fwd", **{f"open_{s}": s for s in counts}}
    along = _over([*KEY, "lane"], "frag_us", SO_FAR)
    stitched = _stitched(fragments, gap_us, slice_us, looks_back).selectExpr(
        "*", *[f"last(if(opens, {v}, NULL), true) {along} AS {c}" for c, v in opening.items()]
    )
    entry = ["frag_us", "flow_us", "flow_pkt", "flow_fwd"]
    entry += [f"{s} - open_{s} AS {s}" for s in counts]
    entry += [f"if(prev_{d} >= flow_us, prev_{d}, NULL) AS prev_{d}" for d in directions]
    # At most two border fragments exist per slice, so this list has at most two entries.
    borders = (
        stitched.where("lane IS NULL AND NOT opens")
        .groupBy(*SLICE)
        .agg(F.expr(f"collect_list(struct({', '.join(entry)})) AS borders"))
    )
    joined = marked.join(borders, SLICE, "left").selectExpr(
        "*", "get(filter(borders, e -> e.frag_us = frag_us), 0) AS hit"
    )
    positions, gaps = [], []
    for d, cond in directions.items():
        positions.append(f"if({cond}, n_{d} - frag_n_{d} + coalesce(hit.skip_{d}, 0L), NULL)")
        gaps.append(f"if({cond}, ts_us - coalesce({_within(f'before_{d}')}, hit.prev_{d}), NULL)")
    return joined.selectExpr(
        "pkt_id",
        "ts_us",
        *FLOW_KEY,
        "coalesce(hit.flow_pkt, frag_pkt) AS flow_id",
        "coalesce(hit.flow_us, frag_us) AS flow_us",
        "if(fwd = coalesce(hit.flow_fwd, frag_fwd), 's', 'd') AS dir",
        "n - frag_n + coalesce(hit.skip, 0L) AS pos",
        f"coalesce({', '.join(positions)}) AS dir_pos",
        f"coalesce({', '.join(gaps)}) AS gap_us",
        "pkt_len",
        "payload_len",
        "tcp_window",
        "tcp_seq",
        "tcp_flags",
        "ttl",
    )


def flag_histogram(packets: DataFrame, gap_us: int = DEFAULT_GAP_US, mode: str = OBSERVED) -> DataFrame:
    """Packets per (flow, TCP flags), in long form."""
    return (
        packet_flows(packets, gap_us, mode)
        .where(F.col("tcp_flags").isNotNull())
        .groupBy("flow_id", "tcp_flags")
        .agg(F.count("*").alias("packets"))
    )


def native_sessions(
    packets: DataFrame, gap_us: int = DEFAULT_GAP_US, slice_us: int | None = None
) -> DataFrame:
    """Flow bounds and sizes with ``session_window`` (W4, S1 in batch form).

    Sessions are first built per time slice, then the few that touch a slice border are
    merged per key, so a busy key is reduced before it meets in one task.
    """
    slice_us = slice_us or default_slice_us(gap_us)
    p = with_flow_key(ipv4_only(packets)).withColumn(
        "slice_us", F.col("ts_us") - F.pmod("ts_us", F.lit(slice_us))
    )
    parts = (
        p.groupBy(*FLOW_KEY, "slice_us", F.session_window("ts", f"{gap_us} microseconds"))
        .agg(
            F.count("*").alias("pkts"),
            F.sum("pkt_len").alias("bytes"),
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
        )
        .drop("session_window")
    )
    border = (F.col("first_us") - F.col("slice_us") < gap_us) | (
        F.col("slice_us") + slice_us - F.col("last_us") <= gap_us
    )
    span = (F.col("last_us") - F.col("first_us") + gap_us).cast("string")
    return (
        parts.withColumn("lane", F.when(~border, F.col("slice_us")))
        .withColumn("start", F.timestamp_micros("first_us"))
        .groupBy(
            *FLOW_KEY,
            "lane",
            F.session_window("start", F.concat(span, F.lit(" microseconds"))),
        )
        .agg(
            F.min("first_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.sum("pkts").alias("pkts"),
            F.sum("bytes").alias("bytes"),
        )
        .select(*FLOW_KEY, "first_us", "last_us", "pkts", "bytes")
    )


def distinct_sources(
    packets: DataFrame, window_us: int, slice_us: int | None = None, most: int = MOST_PACKETS
) -> DataFrame:
    """Per packet, the distinct sources its destination heard in the ``window_us`` up to it.

    The presence of a source at a destination is a set of time intervals: flows of the pair
    with the window as idle gap, each lasting the window beyond its last packet.  The count is
    a running sum of starts and ends, taken inside time slices and then over slices, so a
    busy destination is spread over its slices.  Any width of slices gives the same result; a
    destination that is attacked inside one narrows them.
    """
    p = ipv4_only(packets)
    if slice_us is None:
        slice_us = max(1, 16 * window_us)
        slice_us = slice_us if plan_bytes(packets) < most else _fitting(p, ["dst"], slice_us, most)
    zero = F.lit(0)
    pairs = flow_totals(p.withColumns({"sport": zero, "dport": zero, "proto": zero}), window_us)
    no_packet = F.lit(None).cast("long").alias("pkt_id")
    steps = (
        pairs.select("dst", F.col("first_us").alias("at"), F.lit(1).alias("step"), no_packet)
        .union(pairs.select("dst", F.col("last_us") + window_us, F.lit(-1), no_packet))
        .union(p.select("dst", "ts_us", F.lit(0), "pkt_id"))
        .withColumn("slice", F.floor(F.col("at") / slice_us))
    )
    # Starts and ends come before packets of the same microsecond.
    along = Window.partitionBy("dst", "slice").orderBy("at", F.col("pkt_id").isNotNull())
    steps = steps.withColumn("inside", F.sum("step").over(along))
    before = Window.partitionBy("dst").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.groupBy("dst", "slice").agg(F.sum("step").alias("total"))
    carried = carried.select("dst", "slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("ahead"))
    found = steps.where(F.col("pkt_id").isNotNull()).join(carried, ["dst", "slice"])
    return found.select("pkt_id", "dst", (F.col("inside") + F.col("ahead")).cast("long").alias("sources"))
