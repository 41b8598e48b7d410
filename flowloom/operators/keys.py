"""Keys, lookups and keyed updates (K1-K5, T3, T4, W6, J4, SNK3)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.session import materialise, plan_bytes

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


PART_BYTES = 64 << 20


def number_rows(
    df: DataFrame, order: list[str], name: str = "row_id", start: int = 1, parts: int | None = None
) -> DataFrame:
    """Consecutive ids in ``order`` without a single-task window.

    Rows are range-partitioned and sorted, which spreads any repeated value that the
    full order tells apart.  The result is stored once, the rows per partition are
    counted, and each partition's offset is added.  ``order`` must be a total order.
    ``parts`` follows the input: one for every ``PART_BYTES``, or as many as shuffles use.
    """
    spark = df.sparkSession
    if parts is None:
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, plan_bytes(df) // PART_BYTES))
    stored = materialise(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    part = F.shiftright("_slot", _LOCAL_BITS).cast("int")
    counts = {r["part"]: r["n"] for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    most = max(counts, default=-1) + 1
    offsets = spark.createDataFrame(
        list(enumerate(accumulate((counts.get(i, 0) for i in range(most)), initial=start))), "part int, first long"
    )  # one row per partition
    local = F.col("_slot").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        stored.withColumn("part", part)
        .join(F.broadcast(offsets), "part")
        .withColumn(name, F.col("first") + local)
        .select(name, *df.columns)
    )


def fill_keys(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep given keys; rows without one are numbered in ``order`` after the largest (K1)."""
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first()["top"]
    named = df.where(F.col(key).isNotNull())
    blank = df.where(F.col(key).isNull()).drop(key)
    return named.unionByName(number_rows(blank, order, key, top + 1))


def hash_key(*columns: str) -> Column:
    """A key computed from the natural key alone; needs no shuffle (K1)."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count (K2)."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of every key (K2).

    The rank filter is applied per task before the shuffle, so a busy key sends one row
    per task.
    """
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with one key; the comparison reaches the file scan (K3)."""
    return df.where(F.col(key) == value)


def lookup_many(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed (K3); repeated keys are reduced in each task before the shuffle."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def range_read(df: DataFrame, key: str, low, high, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``low <= key <= high`` in key order (K4, T4)."""
    return df.where(F.col(key).between(low, high)).orderBy(key, *then)


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows."""
    return df.orderBy(*order).limit(n)


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Everything but the listed keys (K5)."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def apply_predictions(results: DataFrame, predictions: DataFrame) -> DataFrame:
    """Fill in predictions by ``row_id`` (SNK3, J4).

    Value and label are replaced where a prediction exists; ``rag_output`` only when the
    prediction brings one.  ``predictions`` has at most one row per id.
    """
    new = predictions.select(
        "row_id",
        F.col("prediction").alias("_prediction"),
        F.col("label").alias("_label"),
        F.col("rag_output").alias("_rag_output"),
    )
    joined = results.join(new, "row_id", "left")
    for name in ("prediction", "label", "rag_output"):
        joined = joined.withColumn(name, F.coalesce(f"_{name}", name))
    return joined.select(*results.columns)


def unknown_predictions(results: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions for ids that are not stored: reported, not applied (SNK3)."""
    return predictions.join(results.select("row_id"), "row_id", "left_anti")
