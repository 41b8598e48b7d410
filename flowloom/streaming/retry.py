"""Records whose scoring failed are tried again (S5): a table of retries, read back as a second stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.streaming.scoring import AVAILABLE_NOW, Trigger, write_batch

ATTEMPTS = 3
WAITING = "row_id long, line string, attempt int, due timestamp"


def retries(spark: SparkSession, retry: str, files_per_trigger: int = 64) -> DataFrame:
    """The waiting records as a stream; every attempt writes its failures there again."""
    return spark.readStream.schema(WAITING).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).parquet(retry)


def score_with_retries(
    records: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    results: str,
    dead: str,
    retry: str,
    checkpoint: str,
    source: str,
    attempts: int = ATTEMPTS,
    wait: str = "0 seconds",
    trigger: Trigger = AVAILABLE_NOW,
) -> StreamingQuery:
    """Score a stream of records; failures wait in ``retry``, or end in ``dead`` after ``attempts``.

    ``records`` is (row_id, line), or what ``retries`` gives; start one query for each, with its own
    ``source`` name and checkpoint.  ``score`` maps (row_id, line, attempt, ...) to scored rows with ``score_status``.
    A record is stored exactly once: in ``results`` when an attempt succeeds, in ``dead`` with reason
    ``failed`` when the last one does not.  Attempts are numbered from 1 and come at least ``wait`` after
    the one before; a record that is not due goes back to the table as it is.
    """
    fresh = "attempt" not in records.columns
    if fresh:
        records = records.select("row_id", "line", F.lit(1).alias("attempt"), F.lit(None).cast("timestamp").alias("due"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        now = F.current_timestamp()
        due = F.coalesce(F.col("due") <= now, F.lit(True))
        batch = batch.withColumn("ready", due).persist()
        tried = score(batch.where("ready").drop("ready", "due")).persist()
        try:
            bad = F.col("score_status") == "error"
            write_batch(tried.where(~bad).drop("line"), f"{results}/source={source}", batch_id)
            last = F.col("attempt") >= attempts
            failed = tried.where(bad).select("row_id", "line", "attempt")
            write_batch(failed.where(last).select("row_id", "line", F.lit("failed").alias("reason")), f"{dead}/source={source}", batch_id)
            again = failed.where(~last).select(
                "row_id", "line", (F.col("attempt") + 1).alias("attempt"), (now + F.expr(f"INTERVAL {wait}")).alias("due")
            )
            again = again.union(batch.where("NOT ready").select(*again.columns))
            write_batch(again, f"{retry}/source={source}", batch_id)
        finally:
            tried.unpersist()
            batch.unpersist()

    return records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def drain(
    spark: SparkSession,
    score: Callable[[DataFrame], DataFrame],
    results: str,
    dead: str,
    retry: str,
    checkpoint: str,
    attempts: int = ATTEMPTS,
    wait: str = "0 seconds",
) -> int:
    """Run the retry stream until nothing waits; returns the number of runs, at most one per attempt if ``wait`` is 0.

    For tables that are worked through once; a service keeps the retry stream running instead.
    """
    runs = 0
    while True:
        query = score_with_retries(retries(spark, retry), score, results, dead, retry, checkpoint, "retry", attempts, wait)
        query.awaitTermination()
        runs += 1
        if not sum(p["numInputRows"] for p in query.recentProgress):
            return runs
