"""Scoring, first-anomaly gate and live counts on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.records import dead_letters, screen_records
from flowloom.operators.scoring import anomalies
from flowloom.schemas import FIRST_ANOMALIES
from flowloom.sources.results import load_table

Trigger = dict[str, object]


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold while a query starts, which keeps its own copy of them."""
    before = {name: spark.conf.get(name, None) for name in conf}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


AVAILABLE_NOW: Trigger = {"availableNow": True}


def write_batch(df: DataFrame, path: str, batch_id: int) -> str:
    """One folder per micro-batch, replaced when the batch is replayed."""
    folder = f"{path}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(folder)
    return folder


def score_stream(
    lines: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    results: str,
    dead: str,
    checkpoint: str,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """Screen, fill, score and store every record line as it arrives (S3).

    ``score`` maps screened records to labelled rows: the same function serves batch
    tables.  Pace the stream with ``trigger`` and the source's file limit (S6).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Both outputs read the screened batch; it is parsed once.
        screened = screen_records(batch).persist()
        try:
            write_batch(score(screened), results, batch_id)
            write_batch(dead_letters(screened), dead, batch_id)
        finally:
            screened.unpersist()

    return (
        lines.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def first_anomalies_stream(
    labelled: DataFrame,
    order: list[str],
    path: str,
    checkpoint: str,
    n: int = FIRST_ANOMALIES,
    handle: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """Pass on only the first ``n`` anomalies of the whole stream.

    The state is one row, how many have passed, in two folders that batches take in turn: a
    replayed batch reads what the batch before it left, and replaces its own folders, so it
    yields the same rows again.
    """
    state = f"{path.rstrip('/')}-passed"

    def gate(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        used = 0
        if batch_id > 0:
            used = load_table(spark, f"{state}/slot={(batch_id - 1) % 2}").first()["passed"]
        found = anomalies(batch).orderBy(*order).limit(max(0, n - used)).persist()  # at most n rows
        try:
            passed = used + found.count()
            write_batch(handle(found), path, batch_id)
        finally:
            found.unpersist()
        spark.range(1).select(F.lit(passed).alias("passed")).write.mode("overwrite").parquet(f"{state}/slot={batch_id % 2}")

    return (
        labelled.writeStream.foreachBatch(gate)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def label_counts_stream(
    labelled: DataFrame, path: str, checkpoint: str, trigger: Trigger = AVAILABLE_NOW
) -> StreamingQuery:
    """Rows per label so far, replaced after every micro-batch."""

    def store(batch: DataFrame, _: int) -> None:
        batch.repartition(1).write.mode("overwrite").parquet(path)  # one row per label

    return (
        labelled.groupBy("label")
        .agg(F.count("*").alias("rows"))
        .writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def append_stream(
    df: DataFrame, path: str, checkpoint: str, trigger: Trigger = AVAILABLE_NOW, conf: dict[str, str] | None = None
) -> StreamingQuery:
    """Append a stream to a Parquet table, started under the settings ``conf``."""
    with settings(df.sparkSession, conf or {}):
        return (
            df.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )
