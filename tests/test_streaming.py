import pytest
from helpers import frame, packet
from pyspark.sql import functions as F
from test_flows import GAP, busy_packets

from flowloom.plans import replay
from flowloom.operators.flows import BIDIRECTIONAL, OBSERVED, flow_totals, native_sessions
from flowloom.operators.scaling import Scaler
from flowloom.plans.scoring import record_scorer
from flowloom.schemas import FEATURES
from flowloom.sources.packets import stream_packets
from flowloom.sources.records import stream_lines
from flowloom.streaming.flows import complete_slices, flows_stream, stream_sessions
from flowloom.plans.replay import CLOSING_SRC, add_closing_packets, stage_in_time_order
from flowloom.streaming.scoring import (
    append_stream,
    first_anomalies_stream,
    label_counts_stream,
    score_stream,
)


@pytest.fixture
def staged(spark, tmp_path):
    """Busy packets in several files in time order, with their closing packets."""
    packets = frame(spark, busy_packets(600, 21)).repartition(2)
    path = str(tmp_path / "packets")
    width = stage_in_time_order(packets, path, chunks=3)
    add_closing_packets(packets, path)
    return packets, path, f"{width} microseconds"


def real(df):
    return df.where(F.col("src") != CLOSING_SRC)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("mode", [OBSERVED, BIDIRECTIONAL])
@pytest.mark.parametrize("slice_us", [900_000, None])
def test_stream_equals_batch(spark, staged, tmp_path, mode, slice_us):
    packets, path, delay = staged
    out = str(tmp_path / "out")
    query = flows_stream(
        stream_packets(spark, path, 2), out, str(tmp_path / "state"), str(tmp_path / "ck"), GAP, mode, delay, slice_us
    )
    query.awaitTermination()
    operators = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in operators) == 0
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) > 2  # several micro-batches
    want = flow_totals(packets, GAP, mode)
    assert rows(real(spark.read.parquet(out)).select(*want.columns)) == rows(want)


def test_staged_files_are_small(spark, tmp_path, monkeypatch):
    """A larger table makes more files, which pace a stream, and no larger ones."""
    monkeypatch.setattr(replay, "FILE_ROWS", 50)
    rows = spark.range(1000).select("id", (F.col("id") * 3).alias("ts_us")).coalesce(1)
    width = stage_in_time_order(rows, str(tmp_path / "rows"), chunks=4)
    staged = spark.read.parquet(str(tmp_path / "rows"))
    assert max(r["count"] for r in staged.groupBy(F.input_file_name()).count().collect()) <= 50
    assert staged.count() == staged.distinct().count() == 1000 and 700 < width < 800


def test_session_stream_equals_batch(spark, staged, tmp_path):
    packets, path, delay = staged
    out = str(tmp_path / "out")
    append_stream(
        stream_sessions(stream_packets(spark, path, 2), GAP, delay), out, str(tmp_path / "ck")
    ).awaitTermination()
    assert rows(real(spark.read.parquet(out))) == rows(native_sessions(packets, GAP))


def test_held_packets_count_once_however_often_delivered(spark, tmp_path):
    packets = frame(spark, [packet(1, 0), packet(2, 10)])
    path = str(tmp_path / "p")
    packets.union(packets).write.parquet(path)
    add_closing_packets(packets, path)
    out = str(tmp_path / "out")
    append_stream(
        complete_slices(stream_packets(spark, path), GAP, "1 second"), out, str(tmp_path / "ck")
    ).awaitTermination()
    assert sorted(r["pkt_id"] for r in real(spark.read.parquet(out)).collect()) == [1, 2]


SCALER = Scaler(tuple(FEATURES), (0.0,) * 18, (10.0,) * 18)


def record(i):
    return "{" + ", ".join(f'"{f}": {(i * (j + 3)) % 17}' for j, f in enumerate(FEATURES)) + "}"


def test_scoring_stream_stores_good_rows_and_dead_letters(spark, tmp_path):
    source = tmp_path / "lines"
    source.mkdir()
    for part in range(3):
        texts = [record(part * 10 + i) for i in range(10)] + ["", "{broken", "[1]"]
        (source / f"{part}.txt").write_text("\n".join(texts) + "\n")
    results, dead = str(tmp_path / "results"), str(tmp_path / "dead")
    score = record_scorer(SCALER)
    for _ in range(2):  # the second run finds nothing new
        score_stream(
            stream_lines(spark, str(source), 1), score, results, dead, str(tmp_path / "ck")
        ).awaitTermination()
    stored = spark.read.parquet(results)
    assert stored.count() == 30
    reasons = {r["reason"]: r["count"] for r in spark.read.parquet(dead).groupBy("reason").count().collect()}
    assert reasons == {"malformed": 3, "not_object": 3}

    from flowloom.operators.records import screen_records

    batch = score(screen_records(spark.createDataFrame([(record(i),) for i in range(30)], "line string")))
    columns = ["sbytes", "prediction", "label"]
    assert rows(stored.select(*columns)) == rows(batch.select(*columns))


LABELLED = "row_id long, ts_us long, label string"


@pytest.fixture
def labelled(spark, tmp_path):
    """Three files in time order; anomalies at 1, 3, 4, 5, 7, 8."""
    path = str(tmp_path / "labelled")
    for part in range(3):
        batch = [(i, i * 10, "normal" if i % 4 in (0, 2) and i != 4 and i != 8 else "dos") for i in range(part * 3, part * 3 + 3)]
        spark.createDataFrame(batch, LABELLED).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(LABELLED).option("maxFilesPerTrigger", 1).parquet(path), path


def test_only_the_first_anomalies_pass(spark, labelled, tmp_path):
    stream, path = labelled
    out = str(tmp_path / "first")
    first_anomalies_stream(stream, ["ts_us", "row_id"], out, str(tmp_path / "ck")).awaitTermination()
    got = sorted(r["row_id"] for r in spark.read.parquet(out).collect())
    want = [r["row_id"] for r in spark.read.parquet(path).where("label != 'normal'").orderBy("row_id").limit(3).collect()]
    assert got == want


def test_replaying_a_batch_passes_the_same_anomalies(spark, labelled, tmp_path):
    """A restart without its checkpoint runs every batch again into the same folders."""
    stream, _ = labelled
    out = str(tmp_path / "first")
    seen = []
    for attempt in range(2):
        first_anomalies_stream(stream, ["ts_us", "row_id"], out, str(tmp_path / f"ck{attempt}")).awaitTermination()
        seen.append(rows(spark.read.parquet(out)))
    assert seen[0] == seen[1] and len(seen[0]) == 3


def test_label_counts_grow_with_the_stream(spark, labelled, tmp_path):
    stream, path = labelled
    out = str(tmp_path / "counts")
    label_counts_stream(stream, out, str(tmp_path / "ck")).awaitTermination()
    assert rows(spark.read.parquet(out)) == rows(spark.read.parquet(path).groupBy("label").count())
