"""Column orders, schemas and constants shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Feature names and order are an external contract.  The blank inside
# "ct_src_ ltm" belongs to the name.
FEATURES = [
    "dur",
    "sbytes",
    "dbytes",
    "Sload",
    "swin",
    "stcpb",
    "smeansz",
    "Sjit",
    "Djit",
    "Stime",
    "Sintpkt",
    "tcprtt",
    "synack",
    "ct_srv_src",
    "ct_srv_dst",
    "ct_dst_ltm",
    "ct_src_ ltm",
    "ct_dst_src_ltm",
]

INTEGER_FEATURES = {
    "sbytes",
    "dbytes",
    "swin",
    "stcpb",
    "ct_srv_src",
    "ct_srv_dst",
    "ct_dst_ltm",
    "ct_src_ ltm",
    "ct_dst_src_ltm",
}

# Class index -> label.
LABELS = [
    "analysis",
    "backdoor",
    "backdoors",
    "dos",
    "exploits",
    "fuzzers",
    "generic",
    "normal",
    "reconnaissance",
    "shellcode",
    "worms",
]
NORMAL_INDEX = 7
NORMAL_LABEL = "normal"

DEFAULT_GAP_US = 2_000_000  # idle time that closes a flow
NORMAL_THRESHOLD = 0.15  # P(normal) from here on means "normal"
TOP_K = 5  # documents retrieved per query
FIRST_ANOMALIES = 3  # anomalies that get an explanation
MIN_DUR_S = 0.001
MIN_GAP_S = 0.0001
MAX_PAYLOAD = 1500
# ----------------------------------------------------------------------------

FLOW_KEY = ["src", "sport", "dst", "dport", "proto"]

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("pkt_id", T.LongType(), False),
        T.StructField("ts_us", T.LongType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("ip_version", T.IntegerType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("sport", T.IntegerType(), False),
        T.StructField("dport", T.IntegerType(), False),
        T.StructField("proto", T.IntegerType()),
        T.StructField("pkt_len", T.LongType(), False),
        T.StructField("payload_len", T.LongType(), False),
        T.StructField("tcp_window", T.LongType()),
        T.StructField("tcp_seq", T.LongType()),
        T.StructField("tcp_flags", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
    ]
)

FEATURE_FIELDS = [
    T.StructField(name, T.LongType() if name in INTEGER_FEATURES else T.DoubleType())
    for name in FEATURES
]
FEATURE_SCHEMA = T.StructType(FEATURE_FIELDS)

PREDICTION_FIELDS = [
    T.StructField("prediction", T.DoubleType()),
    T.StructField("label", T.StringType()),
    T.StructField("rag_output", T.StringType()),
]

# Stored result rows: a stable id, the 18 features, three prediction columns.
RESULT_SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType(), False), *FEATURE_FIELDS, *PREDICTION_FIELDS]
)

# The CSV form of the same table carries no id and stores every number as double.
RESULT_CSV_SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in FEATURES] + PREDICTION_FIELDS
)


def quoted(name: str) -> str:
    """Back-tick a column name for use in expressions."""
    return f"`{name}`"
