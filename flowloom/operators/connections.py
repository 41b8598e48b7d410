"""Counters over the last connections (X1): how many of the last hundred share an end.

The window is one over the whole table's order, which no key divides.  Flows are therefore numbered by
time, and the numbers cut into slices; a slice also gets the last ``last - 1`` flows before it.
Inside a slice each counter is a range frame over numbers, so a task sees at most a slice of
a key, even if the key holds all flows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.keys import number_rows

LAST = 100
SLICE_ROWS = 20_000

#: Counter -> what its connections have in common; a service is a port and protocol.
SHARED = {
    "ct_src_ltm": ["src"],
    "ct_dst_ltm": ["dst"],
    "ct_srv_ltm": ["dport", "proto"],
    "ct_src_dport_ltm": ["src", "dport"],
    "ct_dst_src_ltm": ["src", "dst"],
}


def connection_counters(
    flows: DataFrame, order: tuple[str, ...] = ("last_us", "flow_id"), last: int = LAST, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Per flow, how many of the ``last`` flows up to it share its source, destination, service or pair.

    Flows are ordered by when they ended, equal times by id; a flow counts itself.  The first flows
    have fewer before them.  Null ends are equal to each other.
    """
    if last < 1 or slice_rows < 1:
        raise ValueError("last and slice_rows must be at least 1")
    ends = sorted({c for columns in SHARED.values() for c in columns})
    numbered = number_rows(flows.select(*dict.fromkeys([*order, "flow_id", *ends])), list(order), "rank", start=0)
    own = F.floor(F.col("rank") / slice_rows)
    reached = F.floor((F.col("rank") + last - 1) / slice_rows)
    dealt = numbered.withColumn("slice", F.explode(F.sequence(own, reached))).repartition("slice")
    counters = {
        name: F.count("*").over(Window.partitionBy("slice", *columns).orderBy("rank").rangeBetween(1 - last, 0))
        for name, columns in SHARED.items()
    }
    return dealt.withColumns(counters).where(F.col("slice") == own).select("flow_id", *SHARED)
