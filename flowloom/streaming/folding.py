"""Flows from a packet stream that keeps one row per open flow.

What is behind the watermark can no longer change, so it is folded into its flow at once: a packet is
held only while a packet before it may still arrive.  A burst on one key therefore grows the
state by the packets of the watermark's delay, and what is older by nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.functions.packets import ipv4_only
from flowloom.operators.flows import OBSERVED, default_slice_us, fragment_totals, merge_fragments, oriented_totals
from flowloom.schemas import DEFAULT_GAP_US
from flowloom.session import materialise
from flowloom.streaming.scoring import AVAILABLE_NOW, Trigger, write_batch


def folded_flows_stream(
    packets: DataFrame,
    out: str,
    late: str,
    state: str,
    checkpoint: str,
    delay_us: int,
    gap_us: int = DEFAULT_GAP_US,
    mode: str = OBSERVED,
    slice_us: int | None = None,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """Write ``flow_totals`` rows to ``out`` as flows close, and packets behind the watermark to ``late``.

    The watermark of a micro-batch is ``delay_us`` behind the newest packet up to it.  Packets
    below it are reduced to fragments and merged with the flows left open; a flow that no later packet
    can reach is written.  Held are the packets not yet below the watermark, once each however often they were delivered,
    one row per open flow, and the watermark.  All of it alternates between two folders, and
    outputs are replaced by batch id, so a replay repeats the same result.  A packet that is late
    or was folded before counts as late when it comes again; ``correct_flows`` drops what it knows.
    """
    slice_us = slice_us or default_slice_us(gap_us)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, after = f"{state}/slot={(batch_id - 1) % 2}", f"{state}/slot={batch_id % 2}"
        watermark, opened, arrived = None, None, ipv4_only(batch)
        if batch_id > 0:
            watermark = spark.read.parquet(f"{before}/watermark").first()["at"]
            opened = spark.read.parquet(f"{before}/open")
        behind = F.lit(False) if watermark is None else F.col("ts_us") < watermark
        write_batch(arrived.where(behind), late, batch_id)
        held = arrived.where(~behind)
        if batch_id > 0:
            held = held.unionByName(spark.read.schema(batch.schema).parquet(f"{before}/held"))
        held = materialise(held.dropDuplicates(["pkt_id"]))
        newest = held.agg(F.max("ts_us")).first()[0]
        reached = max((w for w in (watermark, None if newest is None else newest - delay_us) if w is not None), default=None)
        past = F.lit(False) if reached is None else F.col("ts_us") < reached
        fragments = fragment_totals(held.where(past), gap_us, mode, slice_us)
        squares = [c for c in fragments.columns if c.startswith("gap_sq_")]
        fragments = fragments.withColumns({c: F.col(c).cast("decimal(38,0)") for c in squares})
        if opened is not None:
            fragments = fragments.unionByName(opened)
        flows = materialise(merge_fragments(fragments, gap_us, mode, slice_us, watermark))
        closed = F.lit(False) if reached is None else F.col("last_us") + gap_us < reached
        write_batch(oriented_totals(flows.where(closed), mode), out, batch_id)
        still_open = flows.where(~closed).withColumn("slice_us", F.lit(None).cast("long"))
        still_open.write.mode("overwrite").parquet(f"{after}/open")
        held.where(~past).write.mode("overwrite").parquet(f"{after}/held")
        spark.range(1).select(F.lit(reached).cast("long").alias("at")).write.mode("overwrite").parquet(f"{after}/watermark")

    return packets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
