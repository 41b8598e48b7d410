"""Stored results: Parquet tables and their CSV form (SRC4, SRC5, SNK1, SNK2, SNK4-SNK6)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.schemas import FEATURES, RESULT_CSV_SCHEMA, RESULT_SCHEMA, quoted


def table_exists(spark: SparkSession, path: str) -> bool:
    """Is there a Parquet table at ``path``? (SNK6)"""
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A saved scaler, label map or corpus; a missing one is an error (SRC5)."""
    if not table_exists(spark, path):
        raise FileNotFoundError(f"no table at {path}; build it first")
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str) -> str:
    """Replace the table at ``path``; vectors and their documents share rows (SNK6)."""
    df.write.mode("overwrite").parquet(path)
    return path


def stored_rows(features: DataFrame) -> DataFrame:
    """Feature rows with empty prediction columns, in the result schema (SNK2).

    A value that an integer feature cannot hold (not finite, or out of range) is stored as null.
    """
    empty = [F.lit(None).alias(n) for n in ("prediction", "label", "rag_output")]
    return result_rows(features.drop("prediction", "label", "rag_output").select("*", *empty))


def result_rows(labelled: DataFrame) -> DataFrame:
    """Labelled rows in the result schema, for tables and streams alike; see ``stored_rows``."""
    columns = labelled if "rag_output" in labelled.columns else labelled.withColumn("rag_output", F.lit(None))
    return columns.select(
        *[F.col(quoted(f.name)).try_cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA]
    )


def append_results(rows: DataFrame, path: str) -> None:
    """Append to the result table; refuses rows with other columns or types (SNK1, SNK2)."""
    want = [(f.name, f.dataType) for f in RESULT_SCHEMA]
    have = [(f.name, f.dataType) for f in rows.schema]
    if want != have:
        raise ValueError(f"rows do not fit the result table: {have}")
    rows.write.mode("append").parquet(path)


def append_scaled(scaled: DataFrame, path: str) -> None:
    """Append scaled features under the same row id (SNK4); unscaled rows stay out."""
    scaled.where(F.col("score_status") != "unscaled").select(
        "row_id", *[quoted(f) for f in FEATURES]
    ).write.mode("append").parquet(path)


def write_anomalies(labelled: DataFrame, path: str) -> None:
    """Anomalies in their own table, one folder per label (SNK5)."""
    found = labelled.where(F.col("label") != "normal")
    # Rows of a label are brought together by size, so that a task does not write a file per label.
    found.hint("rebalance", "label").write.mode("overwrite").partitionBy("label").parquet(path)


def write_results_csv(results: DataFrame, path: str) -> None:
    """The result table as CSV with a header; texts may span lines."""
    results.select(*[quoted(n) for n in RESULT_CSV_SCHEMA.names]).write.mode("overwrite").option(
        "header", True
    ).option("escape", '"').csv(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read result CSV by position, so older header names and short headers are fine (SRC4).

    Records with a number that does not parse are left out; ``bad_results_csv`` has them.
    """
    return _csv_rows(spark, path).where(~_unreadable()).select(
        *[F.col(quoted(f.name)).try_cast(f.dataType).alias(f.name) for f in RESULT_CSV_SCHEMA]
    )


def bad_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """The records that ``read_results_csv`` leaves out, as text; with the others they are all."""
    whole = F.to_csv(F.struct(*map(quoted, RESULT_CSV_SCHEMA.names)))
    return _csv_rows(spark, path).where(_unreadable()).select(whole.alias("record"))


def _csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All records, every field as text; fields that a record lacks are null."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in RESULT_CSV_SCHEMA.names])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    return reader.option("multiLine", True).option("escape", '"').csv(path)


def _unreadable() -> Column:
    """Does a numeric field hold text that is no number?"""
    numbers = [F.col(quoted(f.name)) for f in RESULT_CSV_SCHEMA if f.dataType != T.StringType()]
    return reduce(or_, [c.isNotNull() & c.try_cast("double").isNull() for c in numbers])
