"""Flows from a packet stream.

``stream_sessions`` uses ``session_window``.  ``flows_stream`` computes everything the
batch operators compute, with the batch operators: the stream only holds packets back
until the watermark has passed their time slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.functions.packets import ipv4_only, with_flow_key
from flowloom.operators.flows import (
    OBSERVED,
    default_slice_us,
    fragment_totals,
    merge_fragments,
    oriented_totals,
)
from flowloom.schemas import DEFAULT_GAP_US, FLOW_KEY
from flowloom.session import materialise
from flowloom.streaming.scoring import AVAILABLE_NOW, Trigger, settings, write_batch

# Settings to start session streams with: merge a busy key's sessions in each task before the
# shuffle, and keep state on disk rather than in memory.
SESSION_SETTINGS = {
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

_PACKET = [
    "pkt_id",
    "ts_us",
    "ip_version",
    *FLOW_KEY,
    "pkt_len",
    "payload_len",
    "tcp_window",
    "tcp_seq",
    "tcp_flags",
]


def stream_sessions(packets: DataFrame, gap_us: int = DEFAULT_GAP_US, delay: str = "10 seconds") -> DataFrame:
    """Flow bounds and sizes, emitted once the watermark passes the flow's end.

    Start the query under ``settings(spark, SESSION_SETTINGS)``.
    """
    return (
        with_flow_key(ipv4_only(packets))
        .withWatermark("ts", delay)
        .groupBy(*FLOW_KEY, F.session_window("ts", f"{gap_us} microseconds"))
        .agg(
            F.min("ts_us").alias("first_us"),
            F.max("ts_us").alias("last_us"),
            F.count("*").alias("pkts"),
            F.sum("pkt_len").alias("bytes"),
        )
        .select(*FLOW_KEY, "first_us", "last_us", "pkts", "bytes")
    )


def complete_slices(packets: DataFrame, slice_us: int, delay: str) -> DataFrame:
    """Hold packets back until the watermark passes the end of their time slice.

    Every packet is its own group, so state spreads evenly however busy one flow key is;
    a packet delivered twice counts once.  Later packets are dropped and counted by the
    engine (S7).
    """
    return (
        with_flow_key(ipv4_only(packets))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{slice_us} microseconds"), *_PACKET)
        .agg(F.count("*").alias("deliveries"))
        .select(*_PACKET)
    )


def flows_stream(
    packets: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    gap_us: int = DEFAULT_GAP_US,
    mode: str = OBSERVED,
    delay: str = "10 seconds",
    slice_us: int | None = None,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """Write ``flow_totals`` rows to ``out`` as flows close; equal to the batch result.

    Slices complete in time order.  A micro-batch reduces its packets to fragments, merges
    them with the flows left open, writes those that no later packet can reach and keeps
    the rest, one row per open flow, for the next micro-batch.  State alternates between
    two folders and outputs are replaced by batch id, so a replay repeats the same result.
    """
    slice_us = slice_us or default_slice_us(gap_us)

    def step(batch: DataFrame, batch_id: int) -> None:
        fragments = fragment_totals(batch, gap_us, mode, slice_us)
        squares = [c for c in fragments.columns if c.startswith("gap_sq_")]
        fragments = fragments.withColumns({c: F.col(c).cast("decimal(38,0)") for c in squares})
        if batch_id > 0:
            earlier = batch.sparkSession.read.parquet(f"{state}/slot={(batch_id - 1) % 2}")
            fragments = fragments.unionByName(earlier)
        flows = materialise(merge_fragments(fragments, gap_us, mode, slice_us))
        newest = flows.agg(F.max("slice_us")).first()[0]
        # Later slices start here or after; null when the batch brought no packets.
        horizon = F.lit(None if newest is None else newest + slice_us).cast("long")
        closed = F.coalesce(F.col("last_us") + gap_us < horizon, F.lit(False))
        write_batch(oriented_totals(flows.where(closed), mode), out, batch_id)
        still_open = flows.where(~closed).withColumn("slice_us", F.lit(None).cast("long"))
        still_open.write.mode("overwrite").parquet(f"{state}/slot={batch_id % 2}")

    with settings(packets.sparkSession, SESSION_SETTINGS):
        return (
            complete_slices(packets, slice_us, delay)
            .writeStream.foreachBatch(step)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
