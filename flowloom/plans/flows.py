"""Flow feature tables from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom.functions.features import with_features
from flowloom.operators.flows import OBSERVED, flow_totals
from flowloom.schemas import FLOW_KEY
from flowloom.sources.packets import packets_from_events

# Events of one user lie hours apart, so their flows close after six idle hours.
EVENT_GAP_US = 6 * 3600 * 1_000_000

FLOW_COLUMNS = ["flow_id", *FLOW_KEY, "first_us"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_from_events(table(spark, sf_dir, "events"))


def flow_features(
    packets: DataFrame, gap_us: int = EVENT_GAP_US, mode: str = OBSERVED
) -> DataFrame:
    """Flow key, start and the 18 features, one row per flow."""
    return with_features(flow_totals(packets, gap_us, mode), FLOW_COLUMNS)
