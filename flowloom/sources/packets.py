"""Packet tables (SRC1) and the adapter that reads the ``events`` table as packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.schemas import PACKET_SCHEMA


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets stored as Parquet in ``PACKET_SCHEMA``."""
    return spark.read.schema(PACKET_SCHEMA).parquet(path)


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packet files as a stream; ``files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(PACKET_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session zone."""
    since = (ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second")
    return (since.cast("decimal(20,6)") * 1_000_000).cast("long")


def packets_from_events(events: DataFrame) -> DataFrame:
    """Read each event as one packet between a user host and a service host.

    The rule is deterministic and row-local, so it adds no shuffle.
    """
    shape = events.select("event_id", "event_type", "user_id", "value", "props", epoch_us(F.col("ts")).alias("ts_us"))
    shape = shape.selectExpr(
        "event_id AS pkt_id",
        "ts_us",
        "if(event_id % 50 = 0, 6, 4) AS ip_version",
        "event_type IN ('signup', 'error') AS rev",
        "CASE user_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END AS proto",
        "concat('10.0.0.', user_id) AS a",
        "concat('192.168.1.', user_id % 7) AS b",
        "CAST(20000 + user_id AS INT) AS user_port",
        "if(user_id % 2 = 0, 80, 443) AS web_port",
        "CAST(floor(value) AS BIGINT) AS size",
        "try_cast(get_json_object(props, '$.k') AS BIGINT) AS k",
        "CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 24 WHEN 'purchase' THEN 17 "
        "WHEN 'signup' THEN 18 ELSE 16 END AS flags",
    ).selectExpr(
        "*",
        "if(proto IN (6, 17), user_port, 0) AS pa",
        "CASE proto WHEN 6 THEN web_port WHEN 17 THEN 53 ELSE 0 END AS pb",
    )
    return shape.selectExpr(
        "pkt_id",
        "ts_us",
        "timestamp_micros(ts_us) AS ts",
        "ip_version",
        "if(rev, b, a) AS src",
        "if(rev, a, b) AS dst",
        "if(rev, pb, pa) AS sport",
        "if(rev, pa, pb) AS dport",
        "proto",
        "40 + size AS pkt_len",
        "if(proto = 6, size * 10, 0L) AS payload_len",
        "if(proto = 6, k * 256, NULL) AS tcp_window",
        "if(proto = 6, pkt_id * 1000, NULL) AS tcp_seq",
        "if(proto = 6, flags, NULL) AS tcp_flags",
        "CAST(64 - k % 4 AS INT) AS ttl",
    )
