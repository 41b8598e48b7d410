"""Stored tables laid out by key (T4, K3-K5, SNK3, J4): ranges, buckets and updates that touch few files.

Everything is Parquet in folders, written with Spark's own mechanisms: range partitioning and
partition folders, bucketed tables, and dynamic partition overwrite.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import materialise, plan_bytes

PART_BYTES = 128 << 20
MOST_PARTS = 100_000
BUCKETS = 64


# --- ranges --------------------------------------------------------------------


def write_ranges(df: DataFrame, path: str, key: str, then: tuple[str, ...] = (), parts: int | None = None) -> None:
    """Write ``df`` in parts, each a range of ``key``, sorted inside, and a list of the ranges.

    ``then`` tells rows with equal keys apart, so that a key that holds many rows spreads over
    several parts.  Rows with a null key come first and are found by ``read_range`` only without
    a lower bound.
    """
    parts = parts or max(1, min(MOST_PARTS, plan_bytes(df) // PART_BYTES))
    placed = df.repartitionByRange(parts, key, *then).sortWithinPartitions(key, *then)
    placed.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    ranges = rows.groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
    ranges.coalesce(1).write.parquet(f"{path}/ranges")


def read_range(spark: SparkSession, path: str, key: str, low=None, high=None) -> DataFrame:
    """Rows with ``low <= key <= high``; only the folders of parts that reach into the range are listed and read.

    Parts are in the order of their ranges, so the wanted ones are a run of numbers.
    """
    ranges = spark.read.parquet(f"{path}/ranges")
    hit = F.lit(True)
    if low is not None:
        hit &= F.col("high") >= F.lit(low)
    if high is not None:
        hit &= F.col("low") <= F.lit(high)
    first = ranges.where(hit).agg(F.min("part").alias("first"), F.max("part").alias("last")).first()
    rows = spark.read.parquet(f"{path}/rows")
    if first["first"] is None:
        return rows.where(F.lit(False)).drop("part")
    rows = rows.where(F.col("part").between(first["first"], first["last"]))
    if low is not None:
        rows = rows.where(F.col(key) >= F.lit(low))
    if high is not None:
        rows = rows.where(F.col(key) <= F.lit(high))
    return rows.drop("part")


# --- bucketed tables --------------------------------------------------------------


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> str:
    """Write a table bucketed and sorted by ``key``; returns its name in the session's catalog.

    Two tables with as many buckets join on their keys, and one groups by its key, without an exchange;
    a single key is looked up in one bucket's files.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    # One task per bucket, so that a bucket is one file.
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


# --- updates by bucket ------------------------------------------------------------


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write ``df`` with one folder per bucket of ``key``, so that updates rewrite few of them."""
    rows = df.withColumn("bucket", _bucket(key, buckets)).hint("rebalance", "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table written by ``write_buckets``."""
    return spark.read.parquet(path).drop("bucket")


def rewrite_buckets(
    spark: SparkSession, path: str, key: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS
) -> list[int]:
    """Apply ``change`` to the rows of the buckets that hold a key of ``touched``, and replace only these.

    ``change`` must keep every other key as it is.  Returns the numbers of the buckets.  The new
    rows are complete in the shared folder before the first old file goes.
    """
    numbers = [r["bucket"] for r in touched.select(_bucket(key, buckets).alias("bucket")).distinct().collect()]
    if not numbers:
        return []
    stored = spark.read.parquet(path)
    old = stored.where(F.col("bucket").isin(numbers))
    new = materialise(change(old.drop("bucket")).withColumn("bucket", _bucket(key, buckets)))
    writer = new.select(*stored.columns).hint("rebalance", "bucket").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r["bucket"] for r in new.select("bucket").distinct().collect()}
    for number in set(numbers) - left:  # nothing is left to overwrite these with
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={number}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(numbers)


def upsert_buckets(spark: SparkSession, path: str, key: str, changes: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Replace the rows whose key is in ``changes``, add those that are new; keys of ``changes`` are unique."""

    def change(old: DataFrame) -> DataFrame:
        return old.join(changes.select(key), key, "left_anti").unionByName(changes.select(*old.columns))

    return rewrite_buckets(spark, path, key, changes, change, buckets)


def delete_from_buckets(spark: SparkSession, path: str, key: str, keys: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Delete the rows whose key is in ``keys``; buckets without such a row may be rewritten unchanged."""
    gone = keys.select(key).distinct()
    return rewrite_buckets(spark, path, key, gone, lambda old: old.join(gone, key, "left_anti"), buckets)
