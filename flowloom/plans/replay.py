"""Replay a table as a file stream in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Two packets far behind any real one, in 2100 and 2200.  The second moves the watermark past
# the first, whose slice then shows that no real flow can go on.
CLOSING_SRC = "closing-marker"
CLOSING_TS_US = [4_102_444_800_000_000, 7_258_118_400_000_000]

# A stream is paced in files and a task reads whole ones, so a file has at most so many rows.
FILE_ROWS = 100_000


def stage_in_time_order(df: DataFrame, path: str, time: str = "ts_us", chunks: int = 4, width: int | None = None) -> int:
    """Write consecutive ranges of time one after the other: of ``width``, or ``chunks`` of about equal size.

    File streams take files in order of modification time.  Returns the widest range in
    microseconds: a watermark delay of that size makes no row late, whichever order the
    files of one range are taken in.  With a ``width`` what a stream holds back depends on the pace of
    the rows, not on how long a time the table covers.  Files have at most ``FILE_ROWS`` rows, so a
    larger table makes more files, hence more micro-batches, and no larger ones.
    """
    first, last = df.agg(F.min(time), F.max(time)).first()
    if first is None:
        df.write.mode("append").parquet(path)
        return 0
    if width:
        inner = range(first + width, last + 1, width)
    else:
        inner = [int(c) for c in df.stat.approxQuantile(time, [i / chunks for i in range(1, chunks)], 0.01)]
    edges = [first, *inner, last + 1]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        df.where((F.col(time) >= low) & (F.col(time) < high)).write.option("maxRecordsPerFile", FILE_ROWS).mode("append").parquet(path)
    return max(high - low for low, high in zip(edges[:-1], edges[1:], strict=True))


def add_closing_packets(packets: DataFrame, path: str) -> None:
    """Append the closing packets, read after everything else."""
    times = packets.sparkSession.createDataFrame([(t,) for t in CLOSING_TS_US], "at long")
    fixed = {
        "pkt_id": -F.col("at"),
        "ts_us": F.col("at"),
        "ts": F.timestamp_micros("at"),
        "ip_version": F.lit(4),
        "src": F.lit(CLOSING_SRC),
        "dst": F.lit(CLOSING_SRC),
    }
    times.select(
        *[fixed.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in packets.schema]
    ).coalesce(1).write.mode("append").parquet(path)
