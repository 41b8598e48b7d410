"""Late packets (S7): set aside instead of dropped, and the flows that they change corrected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.functions.packets import ipv4_only, with_flow_key
from flowloom.operators.flows import BIDIRECTIONAL, OBSERVED, flow_totals
from flowloom.schemas import DEFAULT_GAP_US
from flowloom.session import materialise
from flowloom.streaming.scoring import AVAILABLE_NOW, Trigger, write_batch


def split_late(
    packets: DataFrame, accepted: str, late: str, state: str, checkpoint: str, delay_us: int, trigger: Trigger = AVAILABLE_NOW
) -> StreamingQuery:
    """Archive a packet stream: on-time packets in ``accepted``, those behind the watermark in ``late``.

    The watermark is ``delay_us`` behind the newest packet of all earlier micro-batches.  It is one row, in
    two folders that batches take in turn; archives are replaced by batch id, so a replayed batch
    yields the same files again.  ``flows_stream`` over ``accepted`` drops nothing.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        watermark = None
        if batch_id > 0:
            watermark = spark.read.parquet(f"{state}/slot={(batch_id - 1) % 2}").first()["watermark"]
        batch = batch.persist()
        try:
            behind = F.coalesce(F.col("ts_us") < F.lit(watermark).cast("long"), F.lit(False))
            write_batch(batch.where(~behind), accepted, batch_id)
            write_batch(batch.where(behind), late, batch_id)
            newest = batch.agg(F.max("ts_us")).first()[0]
        finally:
            batch.unpersist()
        reached = [w for w in (watermark, None if newest is None else newest - delay_us) if w is not None]
        row = spark.range(1).select(F.lit(max(reached, default=None)).cast("long").alias("watermark"))
        row.write.mode("overwrite").parquet(f"{state}/slot={batch_id % 2}")

    return packets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _key_of(rows: DataFrame, mode: str) -> DataFrame:
    """Add the key by which flows are kept apart: directed, or the ordered pair of ends."""
    swap = F.lit(False) if mode == OBSERVED else F.struct("src", "sport") > F.struct("dst", "dport")
    ends = [("src", "dst"), ("sport", "dport"), ("dst", "src"), ("dport", "sport")]
    names = ["_a", "_a_port", "_b", "_b_port"]
    return rows.withColumns({n: F.when(swap, F.col(y)).otherwise(F.col(x)) for n, (x, y) in zip(names, ends, strict=True)} | {"_proto": F.col("proto")})


_KEYED = ["_a", "_a_port", "_b", "_b_port", "_proto"]


def _same(left: str, right: str):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in _KEYED])


def correct_flows(
    flows: DataFrame, packets: DataFrame, late: DataFrame, gap_us: int = DEFAULT_GAP_US, mode: str = OBSERVED
) -> tuple[DataFrame, DataFrame]:
    """What late packets change: (ids of flows to retract, flows to add), rows as ``flow_totals`` gives them.

    ``flows`` are the closed flows and ``packets`` what they were made of.  A late packet within a gap of
    closed flows extends or bridges them; any other makes a flow of its own.  Only keys with late
    packets are looked at, and of these only the time from the first to the last flow that a late
    packet can reach: flows lie wholly inside or outside of it, so they are computed anew from their packets.
    A packet that was counted already, or comes late more than once, counts once.
    """
    if mode not in (OBSERVED, BIDIRECTIONAL):
        raise ValueError(f"unknown flow mode: {mode!r}")
    fresh = late.dropDuplicates(["pkt_id"]).join(packets.select("pkt_id"), "pkt_id", "left_anti").select(*packets.columns)
    fresh = materialise(fresh)
    reach = _key_of(with_flow_key(ipv4_only(fresh)), mode).groupBy(*_KEYED).agg(
        (F.min("ts_us") - gap_us).alias("low"), (F.max("ts_us") + gap_us).alias("high")
    )
    keyed = _key_of(flows, mode).select(*_KEYED, "flow_id", "first_us", "last_us")
    hit = _same("f", "r") & (F.col("f.first_us") <= F.col("r.high")) & (F.col("f.last_us") >= F.col("r.low"))
    touched = keyed.alias("f").join(reach.alias("r"), hit).select(*[f"f.{k}" for k in _KEYED], "flow_id", "first_us", "last_us")
    touched = materialise(touched)
    spans = touched.groupBy(*_KEYED).agg(F.min("first_us").alias("low"), F.max("last_us").alias("high"))
    old = _key_of(with_flow_key(ipv4_only(packets)), mode).select("pkt_id", "ts_us", *_KEYED)
    inside = _same("p", "s") & F.col("p.ts_us").between(F.col("s.low"), F.col("s.high"))
    again = old.alias("p").join(spans.alias("s"), inside).select("pkt_id")
    whole = packets.dropDuplicates(["pkt_id"]).join(again, "pkt_id", "left_semi").unionByName(fresh)
    return touched.select("flow_id"), flow_totals(whole, gap_us, mode)


def corrected(flows: DataFrame, retracted: DataFrame, added: DataFrame) -> DataFrame:
    """The flow table after a correction."""
    return flows.join(retracted, "flow_id", "left_anti").select(*added.columns).unionByName(added)
