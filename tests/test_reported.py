"""What cannot be read is reported, and nothing is cut off on the way."""

import math
import random

import pytest

from flowloom.operators.flows import default_slice_us, distinct_sources, fitting_slice_us, fragment_totals
from flowloom.operators.retrieval import encode_corpus, fit_corpus_encoder, top_k
from flowloom.plans.flows import EVENT_GAP_US, event_packets
from flowloom.schemas import PACKET_SCHEMA
from flowloom.sources.records import bad_corpus_lines, read_corpus
from flowloom.sources.results import bad_results_csv, read_results_csv

SF_DIR = "/root/testdata/sf0.001"


def test_corpus_lines_take_their_places(spark, tmp_path):
    lines = ['{"input": "a", "output": "x"}', "", "{broken", '{"input": "b"}', "[1]", '{"output": "no text"}', '{"input": "c", "doc_pos": 90}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    good = {r["input"]: (r["doc_pos"], r["output"]) for r in read_corpus(spark, str(tmp_path)).collect()}
    assert good == {"a": (0, "x"), "b": (2, None), "c": (90, None)}
    bad = {r["line"]: r["reason"] for r in bad_corpus_lines(spark, str(tmp_path)).collect()}
    assert bad == {"{broken": "malformed", "[1]": "malformed", '{"output": "no text"}': "no_input"}


def test_bad_csv_records_are_reported(spark, tmp_path):
    from flowloom.schemas import RESULT_CSV_SCHEMA

    width = len(RESULT_CSV_SCHEMA)
    good = ",".join(["1"] * (width - 2) + ["dos", '"two\nlines"'])
    bad = ",".join(["x"] * (width - 2) + ["dos", "text"])
    (tmp_path / "r.csv").write_text("\n".join([",".join(f"c{i}" for i in range(width)), good, bad, good]))
    assert read_results_csv(spark, str(tmp_path)).count() == 2
    assert [r["record"] for r in bad_results_csv(spark, str(tmp_path)).collect()] == [bad]


def test_scores_that_differ_by_less_than_a_millionth_rank_by_score(spark):
    docs = []
    for i, angle in enumerate([3e-5, 1e-5, 2e-5, 4e-5, 0.0]):  # cosines differ by 5e-11 to 8e-10
        docs.append((i, [math.cos(angle), math.sin(angle)]))
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    corpus = spark.createDataFrame(docs, "doc_pos long, embedding array<double>")
    got = [r["doc_pos"] for r in top_k(query, corpus, 4).orderBy("rank").collect()]
    assert got == [4, 1, 2, 0]


def test_vectors_that_are_not_unit_are_refused(spark):
    df = spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="normalised"):
        top_k(df, df.withColumnRenamed("query_id", "doc_pos")).collect()


def test_search_moves_no_corpus(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        v = [rng.gauss(0, 1) for _ in range(8)]
        n = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / n for x in v]))
    df = spark.createDataFrame(rows, "doc_pos long, embedding array<double>")
    hits = top_k(df.withColumnRenamed("doc_pos", "query_id"), df, 3, True, block_bytes=8 * 8 * 50)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    want = {}
    for i, v in rows:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i)
        want[i] = [j for _, j in scored[:3]]
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_pos"])
    assert got == want


def test_letters_of_every_script_are_words(spark):
    docs = spark.createDataFrame([(0, "müßig über"), (1, "m ig ber"), (2, "MÜSSIG ÜBER"), (3, None), (4, " ")], "doc_pos long, input string")
    out = {r["doc_pos"]: r["embedding"] for r in encode_corpus(docs, fit_corpus_encoder(docs, 4096)).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(out[a], out[b]))
    assert dot(0, 1) == pytest.approx(0)
    assert dot(0, 2) > 0.2  # both hold "über"
    assert dot(3, 3) == dot(4, 4) == 0


def test_fragments_are_fewer_than_packets(spark):
    packets = event_packets(spark, SF_DIR)
    slice_us = default_slice_us(EVENT_GAP_US)
    assert slice_us == 16 * EVENT_GAP_US
    fragments = fragment_totals(packets, EVENT_GAP_US, "observed", slice_us)
    assert fragments.count() < 0.9 * packets.count()


def packet_rows(times, src="s", dst="d"):
    return [(i, t, None, 4, src, dst, 1, 2, 17, 10, 0, None, None, None, 1) for i, t in enumerate(times)]


def packets(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(r[0], r[1], 4, r[4], r[5]) for r in rows], "pkt_id long, ts_us long, ip_version int, src string, dst string")
    fixed = {"ts": F.timestamp_micros("ts_us")}
    return df.select(*[(F.col(f.name) if f.name in df.columns else fixed.get(f.name, F.lit(1))).cast(f.dataType).alias(f.name) for f in PACKET_SCHEMA])


def test_a_bursting_key_gets_narrower_slices(spark):
    rows = packet_rows(range(0, 40_000_000, 1_000))
    df = packets(spark, rows)
    assert fitting_slice_us(df, 2_000_000, most=10_000) < default_slice_us(2_000_000)
    assert fitting_slice_us(df, 2_000_000) == default_slice_us(2_000_000)


def test_distinct_sources_equal_a_plain_count(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(0, 5_000), None, 4, f"s{rng.randrange(6)}", f"d{int(rng.random() < 0.2)}") for i in range(600)]
    window = 150
    got = {r["pkt_id"]: r["sources"] for r in distinct_sources(packets(spark, rows), window, slice_us=400).collect()}
    want = {
        r[0]: len({q[4] for q in rows if q[5] == r[5] and r[1] - window < q[1] <= r[1]}) for r in rows
    }
    assert got == want


def test_given_and_missing_positions_never_meet(spark, tmp_path):
    lines = ['{"input": "a"}', '{"input": "b", "doc_pos": 0}', '{"input": "c"}', '{"input": "d", "doc_pos": 2}', '{"input": "e", "doc_pos": 2}', "{no"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    assert {r["input"]: r["doc_pos"] for r in read_corpus(spark, str(tmp_path)).collect()} == {"a": 3, "b": 0, "c": 5, "d": 2}
    assert {r["line"]: r["reason"] for r in bad_corpus_lines(spark, str(tmp_path)).collect()} == {lines[4]: "repeated_position", "{no": "malformed"}


def test_corpus_is_encoded_row_by_row(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} other {i} word{i % 7}", "x") for i in range(50)], "doc_pos long, input string, embedding string")
    encoder = fit_corpus_encoder(docs, 64)
    encoded = encode_corpus(docs, encoder)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    assert encoded.columns == ["doc_pos", "input", "embedding"]
    twice = encode_corpus(docs.union(docs), encoder).groupBy("doc_pos", "embedding").count().collect()
    assert len(twice) == 50 and all(r["count"] == 2 and len(r["embedding"]) == 64 for r in twice)
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in twice)


def test_attacked_destination_narrows_the_slices(spark):
    from helpers import frame, packet

    rng = random.Random(6)
    rows = [packet(i, rng.randrange(3_000_000), src=f"h{rng.randrange(30)}", dst="victim") for i in range(1500)]
    packets = frame(spark, rows)
    wide = {tuple(r) for r in distinct_sources(packets, 100_000).collect()}
    assert {tuple(r) for r in distinct_sources(packets, 100_000, most=64).collect()} == wide
    assert len(wide) == 1500
