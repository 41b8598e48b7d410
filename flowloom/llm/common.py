"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.session import work_path

WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a rescan, not a recomputation.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def light_driver(spark: SparkSession) -> Iterator[None]:
    """Settings for a loop of many jobs, so that the driver's memory does not follow their number.

    Tables are joined by shuffles only, since each broadcast holds a page of driver memory
    until it is cleaned up, and of each plan only the beginning of its text is kept.  Stages
    run without code of their own: the driver compiles and loads that for each of thousands of plans,
    while the loop's time goes to shuffles, sorts and Arrow batches.
    """
    own = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.maxPlanStringLength": "2000",
        "spark.sql.codegen.wholeStage": "false",
    }
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def batch_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Send at most ``most`` rows at once to Python, so that less text lies in the JVM and in its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, now = spark.conf.get(name, None), int(spark.conf.get(name))
    try:
        spark.conf.set(name, str(most if now <= 0 else min(now, most)))
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, group: list[str], key: str, ties: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one, per ``group``.

    ``key`` is uniform in [0, 1), so fixed slices of it are ranges of equal size: sums are
    taken inside a slice, then over slices, then over bundles of slices.  No window sees
    more than a slice, the slices of a bundle, or the bundles of a group.
    """
    per_slice, per_bundle = 2_000, 1_000
    sizes = df.groupBy(*group).agg(F.count("*").alias("_rows"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group])
    cut = (
        df.alias("l")
        .join(sizes.alias("r"), same)
        .select("l.*", F.ceil(F.col("r._rows") / per_slice).alias("_slices"))
        .withColumn("_slice", F.least(F.floor(F.col(key) * F.col("_slices")), F.col("_slices") - 1))
        .drop("_slices")
    )
    cut = stored(cut, "prefix-slices")
    bundle = F.floor(F.col("_slice") / per_bundle).alias("_bundle")
    slices = cut.groupBy(*group, "_slice").agg(F.sum(value).alias("_total")).withColumn("_bundle", bundle)
    bundles = slices.groupBy(*group, "_bundle").agg(F.sum("_total").alias("_total"))
    before = lambda w: F.coalesce(F.sum("_total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bundles = bundles.select(*group, "_bundle", before(Window.partitionBy(*group).orderBy("_bundle")).alias("_ahead"))
    slices = slices.select(
        *group, "_bundle", "_slice", before(Window.partitionBy(*group, "_bundle").orderBy("_slice")).alias("_inside")
    )
    firsts = (
        slices.alias("l")
        .join(bundles.alias("r"), same & (F.col("l._bundle") == F.col("r._bundle")))
        .select("l.*", "r._ahead")
        .select(*group, "_slice", (F.col("_inside") + F.col("_ahead")).alias("_first"))
    )
    local = Window.partitionBy(*group, "_slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    return (
        rows.alias("l")
        .join(firsts.alias("r"), same & (F.col("l._slice") == F.col("r._slice")))
        .select("l.*", (F.col("l._local") + F.col("r._first")).cast("long").alias(out))
        .drop("_slice", "_local")
    )


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in ``order``, by range partitions and one offset for each."""
    parts = shuffle_partitions(df.sparkSession)
    slot, part = (unused(name, [*df.columns, out]) for name in ("_slot", "_part"))
    placed = stored(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(slot, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(slot, 33)),
        "numbered",
    )
    n, before = unused("_n", df.columns), unused("_first", df.columns)
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    sizes = placed.groupBy(part).agg(F.count("*").alias(n))
    first = sizes.select(part, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(before))
    at = F.col(before) + F.col(slot).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(first), part).select(*df.columns, at.alias(out))


def row_key(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, str]:
    """``df`` and a column that tells its rows apart: the id, or a row number if ids are null or repeat.

    Numbers follow the order of (id, text hash), null first.
    """
    repeated = df.groupBy(id_column).agg(F.count("*").alias("n")).where(F.col(id_column).isNull() | (F.col("n") > 1))
    if repeated.isEmpty():
        return df, id_column
    key = unused("_row", df.columns)
    return numbered(df, [F.col(id_column).asc_nulls_first(), F.xxhash64(text_column)], key), key


def keyed(df: DataFrame, id_column: str, text_column: str, keep: list[str] | None = None) -> tuple[DataFrame, bool]:
    """``df`` as (_uid, _id, _text), and whether the rows had to be numbered for ``_uid``.

    ``_uid`` is unique and ordered as the ids are.  Unique ids are used as they are.  If an id
    is null or repeated, all rows are numbered in the order of (id, text hash), null first, so
    that every row counts on its own.  ``keep`` adds ``_kept``, a struct of other columns.
    """
    rows = df.select(
        F.col(id_column).cast("long").alias("_id"),
        F.col(text_column).cast("string").alias("_text"),
        *([F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept")] if keep else []),
    )
    repeated = rows.groupBy("_id").count().where((F.col("count") > 1) | F.col("_id").isNull())
    if repeated.isEmpty():
        return rows.select(F.col("_id").alias("_uid"), *rows.columns), False
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text")]
    return numbered(rows, order, "_uid").select("_uid", *rows.columns), True


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker does."""
    holder = sys.modules.setdefault("flowloom_worker_cache", types.ModuleType("flowloom_worker_cache"))
    return holder.__dict__.setdefault(name, {})
