"""Do incoming records carry the expected feature names, in order?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.schemas import FEATURES


def expected_names(df: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """The fixed name list as ``(position, name)`` in the session of ``df``."""
    return df.sparkSession.createDataFrame(list(enumerate(names)), "position int, name string")


def observed_names(screened: DataFrame) -> DataFrame:
    """Names seen at each position over all object records, with record counts."""
    names = screened.where(F.col("keys").isNotNull()).select(
        F.posexplode("keys").alias("position", "name")
    )
    return names.groupBy("position", "name").agg(F.count("*").alias("records"))


def name_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Names on one side only: ``missing`` from the records or ``extra`` in them."""
    seen = observed.groupBy("name").agg(F.sum("records").alias("records"))
    extra = seen.join(expected, "name", "left_anti").select(F.lit("extra").alias("side"), "name", "records")
    missing = expected.join(seen, "name", "left_anti").select(
        F.lit("missing").alias("side"), "name", F.lit(0).cast("long").alias("records")
    )
    return extra.unionByName(missing)


def order_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Positions whose names differ; positions beyond the shorter list do not count."""
    return (
        observed.withColumnRenamed("name", "actual")
        .join(expected.withColumnRenamed("name", "expected"), "position")
        .where(F.col("actual") != F.col("expected"))
        .select("position", "expected", "actual", "records")
    )
