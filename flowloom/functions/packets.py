"""Packet predicates and key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYN = 0x02
SYN_OR_ACK = 0x12
ACK = 0x10

TCP, UDP = 6, 17


def any_flag(flags: Column, bits: int) -> Column:
    """True when at least one of ``bits`` is set (any-bit test)."""
    return flags.bitwiseAND(F.lit(bits)) != 0


def ipv4_only(packets: DataFrame) -> DataFrame:
    """Capture filter "ip" (P2)."""
    return packets.where(F.col("ip_version") == 4)


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Directional 5-tuple (P1): non-IP rows go, ports count for TCP and UDP only."""
    return packets.where("src IS NOT NULL AND dst IS NOT NULL AND proto IS NOT NULL").withColumns(
        {port: F.expr(f"if(proto IN ({TCP}, {UDP}), {port}, 0)") for port in ("sport", "dport")}
    )


def with_tcp_fields(packets: DataFrame) -> DataFrame:
    """TCP-only fields (P13): null for other protocols, payload counts as 0."""
    fields = {c: F.expr(f"if(proto = {TCP}, {c}, NULL)") for c in ("tcp_window", "tcp_seq", "tcp_flags")}
    return packets.withColumns(fields | {"payload_len": F.expr(f"if(proto = {TCP}, payload_len, 0L)")})
