"""Newline-delimited JSON records and corpora (SRC2, SRC3, SNK7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.once import computed_once
from flowloom.operators.keys import number_rows
from flowloom.schemas import FEATURES, quoted


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw record lines, one per row, column ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Raw record lines as a stream."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).withColumnRenamed("value", "line")


def feature_line() -> Column:
    """The 18 features as one JSON object, keys in their fixed order."""
    return F.to_json(F.struct(*[F.col(quoted(name)) for name in FEATURES]))


def write_feature_lines(features: DataFrame, path: str) -> None:
    """Emit each feature row as one JSON line (SNK7)."""
    features.select(feature_line().alias("value")).write.mode("overwrite").text(path)


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank corpus line: ``line``, ``doc_pos``, ``input``, ``output`` and ``reason``.

    ``reason`` is null for a document and says otherwise why the line is none.  A line without
    ``doc_pos`` takes its place among all lines, in the order of files and of lines in them; if a
    given position is one of these places, all such lines come after the largest given one
    instead.  Of lines with one given position the first has it, the others are ``repeated_position``.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_order"),  # rises within a block of a file
    )
    doc = F.from_json("line", "doc_pos long, input string, output string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.where(F.col("line").rlike(r"\S")).withColumn("doc", doc)
    reason = F.when(F.col("doc").isNull() | F.col("doc._bad").isNotNull(), "malformed").when(
        F.col("doc.input").isNull(), "no_input"
    )
    parsed = parsed.select("line", "_file", "_start", "_order", "doc.doc_pos", "doc.input", "doc.output", reason.alias("reason"))
    columns = ["line", "doc_pos", "input", "output", "reason"]
    good = parsed.where("reason IS NULL")
    positions = good.groupBy("doc_pos").agg(F.count("*").alias("n"))
    if positions.where("doc_pos IS NULL OR n > 1").isEmpty():
        return parsed.select(*columns)
    placed = number_rows(parsed, ["_file", "_start", "_order"], "_place", start=0)
    good = placed.where("reason IS NULL")
    firsts = good.where("doc_pos IS NOT NULL").groupBy("doc_pos").agg(F.min("_place").alias("_first"))
    taken = good.where("doc_pos IS NULL").join(firsts.select(F.col("doc_pos").alias("_given")), F.col("_place") == F.col("_given"), "left_semi")
    start = 0 if taken.isEmpty() else firsts.agg(F.max("doc_pos")).first()[0] + 1
    late = F.col("reason").isNull() & (F.col("_place") > F.col("_first"))
    return (
        placed.join(firsts, "doc_pos", "left")
        .withColumn("reason", F.when(late, "repeated_position").otherwise(F.col("reason")))
        .withColumn("doc_pos", F.coalesce("doc_pos", F.col("_place") + start))
        .select(*columns)
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a JSON lines corpus; ``bad_corpus_lines`` has the other lines."""
    return corpus_lines(spark, path).where("reason IS NULL").select("doc_pos", "input", "output")


def bad_corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold no document, with the reason; with the documents they make up the file."""
    return corpus_lines(spark, path).where("reason IS NOT NULL").select("line", "reason")


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Write ``(doc_pos, input, output)`` as JSON lines."""
    corpus.select(
        F.to_json(F.struct("doc_pos", "input", "output")).alias("value")
    ).write.mode("overwrite").text(path)


def lines_from_events(events: DataFrame) -> DataFrame:
    """One record line per event, ``(row_id, line)``: integer values and, by turn, every
    kind of odd record a receiver meets."""
    values = [f"CAST((event_id * 7 + user_id * {j}) % 1000 AS STRING)" for j in range(len(FEATURES))]

    def entry(j: int, value: str | None = None, name: str | None = None) -> str:
        """One member; ``value`` is JSON text."""
        text = values[j] if value is None else f"'{value}'"
        return f"""concat('"{name or FEATURES[j]}": ', {text})"""

    def record(changes: dict[int, str] | None = None, extra: tuple[str, ...] = (), drop: int = 0) -> str:
        changes = changes or {}
        entries = [changes.get(j, entry(j)) for j in range(len(FEATURES) - drop)]
        return f"concat('{{', concat_ws(', ', {', '.join([*entries, *extra])}), '}}')"

    last = len(FEATURES) - 1
    kinds = [
        record(),
        record(drop=1),
        record(extra=("""'"extra": 1'""",)),
        record({last: entry(last, name="other")}),
        record({0: entry(0, '" 1.5 "')}),
        record({0: entry(0, '"abc"'), 1: entry(1, "null"), 2: entry(2, "[1]"), 3: entry(3, '{"z": 1}')}),
        record({0: entry(0, "true"), 1: entry(1, '"true"')}),
        record({0: entry(0, '"nan"'), 1: entry(1, '"inf"')}),
        f"substring({record()}, 1, 40)",
        f"concat('[', concat_ws(', ', {', '.join(values)}), ']')",
        record({last: entry(last, name="dur")}),
        "'   '",
        record({0: entry(0, "NaN")}),
    ]
    cases = " ".join(f"WHEN {i} THEN {kind}" for i, kind in enumerate(kinds))
    line = F.expr(f"CASE event_id % {len(kinds)} {cases} END")
    return computed_once(events.select("event_id", "user_id"), {"line": line}).select(
        F.col("event_id").alias("row_id"), "line"
    )
