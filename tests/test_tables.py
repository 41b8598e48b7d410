import pytest
from pyspark.sql import functions as F

from flowloom.operators import keys
from flowloom.schemas import FEATURES, RESULT_SCHEMA
from flowloom.sources.packets import epoch_us
from flowloom.sources.results import (
    append_results,
    append_scaled,
    load_table,
    read_results_csv,
    save_table,
    stored_rows,
    table_exists,
    write_anomalies,
    write_results_csv,
)


def ids(spark, rows, schema="k long, v string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("parts", [1, 5])
def test_numbering_is_consecutive_whatever_the_skew(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # A third of all rows share one time.
        df = spark.range(3000).select(
            F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id")).alias("ts_us")
        )
        got = keys.number_rows(df.repartition(7), ["ts_us", "event_id"], start=11).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r["row_id"] for r in got] == list(range(11, 3011))
    order = [(r["ts_us"], r["event_id"]) for r in got]
    assert order == sorted(order)


def test_given_keys_are_kept(spark):
    df = ids(spark, [(7, "a"), (None, "c"), (3, "d"), (None, "b")])
    got = {r["v"]: r["k"] for r in keys.fill_keys(df, "k", ["v"]).collect()}
    assert got == {"a": 7, "d": 3, "b": 8, "c": 9}


def test_all_keys_missing(spark):
    got = keys.fill_keys(ids(spark, [(None, "b"), (None, "a")]), "k", ["v"]).collect()
    assert {r["v"]: r["k"] for r in got} == {"a": 1, "b": 2}


def test_uniqueness(spark):
    df = ids(spark, [(1, "b"), (1, "a"), (2, "c")])
    assert [tuple(r) for r in keys.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    first = keys.first_per_key(df, ["k"], ["v"])
    assert sorted(map(tuple, first.collect())) == [(1, "a"), (2, "c")]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan  # a busy key is reduced before the shuffle


def test_lookup_range_delete_head(spark):
    df = ids(spark, [(i, str(i)) for i in range(10)])
    wanted = ids(spark, [(3, "x"), (3, "y"), (99, "z")])
    assert keys.lookup(df, "k", 4).first()["v"] == "4"
    assert [r["k"] for r in keys.lookup_many(df, wanted, "k").collect()] == [3]
    assert [r["k"] for r in keys.range_read(df, "k", 2, 4).collect()] == [2, 3, 4]
    assert keys.delete_keys(df, wanted, "k").count() == 9
    assert [r["k"] for r in keys.head(df.repartition(3), ["k"], 2).collect()] == [0, 1]


def test_hash_key_needs_no_shuffle(spark):
    df = ids(spark, [(1, "a"), (1, "a"), (2, "a")]).withColumn("h", keys.hash_key("k", "v"))
    assert df.select("h").distinct().count() == 2
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def features(spark, n):
    return spark.range(n).select(
        F.col("id").alias("row_id"), *[(F.col("id") + i).alias(f) for i, f in enumerate(FEATURES)]
    )


PREDICTED = "row_id long, prediction double, label string, rag_output string"


def test_upsert(spark):
    stored = stored_rows(features(spark, 3))
    one = keys.apply_predictions(stored, spark.createDataFrame([(0, 0.5, "dos", "why"), (1, 0.2, "normal", None)], PREDICTED))
    again = [(0, 0.9, "worms", None), (8, 0.1, "dos", None)]
    two = keys.apply_predictions(one, spark.createDataFrame(again, PREDICTED)).orderBy("row_id").collect()
    assert [(r["prediction"], r["label"], r["rag_output"]) for r in two] == [
        (0.9, "worms", "why"),
        (0.2, "normal", None),
        (None, None, None),
    ]
    unknown = keys.unknown_predictions(stored, spark.createDataFrame(again, PREDICTED))
    assert [r["row_id"] for r in unknown.collect()] == [8]


def test_result_table(spark, tmp_path):
    path = str(tmp_path / "results")
    assert not table_exists(spark, path)
    with pytest.raises(FileNotFoundError):
        load_table(spark, path)
    append_results(stored_rows(features(spark, 2)), path)
    append_results(stored_rows(features(spark, 2)), path)
    assert load_table(spark, path).count() == 4
    assert [f.name for f in load_table(spark, path).schema] == RESULT_SCHEMA.names
    with pytest.raises(ValueError):
        append_results(features(spark, 1), path)


def test_scaled_and_anomaly_tables(spark, tmp_path):
    scaled = features(spark, 4).withColumn("score_status", F.when(F.col("row_id") > 2, "unscaled").otherwise("ok"))
    append_scaled(scaled, str(tmp_path / "scaled"))
    assert load_table(spark, str(tmp_path / "scaled")).count() == 3
    rows = spark.createDataFrame([(1, "dos"), (2, "normal"), (3, "worms")], "row_id long, label string")
    write_anomalies(rows, str(tmp_path / "bad"))
    assert sorted(r["label"] for r in load_table(spark, str(tmp_path / "bad")).collect()) == ["dos", "worms"]
    assert table_exists(spark, save_table(rows, str(tmp_path / "t")))


def test_csv_keeps_multi_line_texts(spark, tmp_path):
    text = 'first line\nsecond, "quoted"\n\nlast'
    rows = keys.apply_predictions(
        stored_rows(features(spark, 2)), spark.createDataFrame([(1, 0.25, "dos", text)], PREDICTED)
    )
    write_results_csv(rows, str(tmp_path / "csv"))
    back = read_results_csv(spark, str(tmp_path / "csv")).orderBy("dur").collect()
    assert [(r["prediction"], r["label"], r["rag_output"]) for r in back] == [(None, None, None), (0.25, "dos", text)]
    assert back[1]["ct_src_ ltm"] == 17.0


def test_csv_with_a_short_header_and_an_old_name(spark, tmp_path):
    header = ",".join([*FEATURES, "reconstruction_error", "label"])
    values = ",".join(str(i) for i in range(18))
    lines = [header, f"{values},64.5,anomaly", f'{values},0.2,dos,"one\ntwo"', f"{values},,,"]
    (tmp_path / "old.csv").write_text("\n".join(lines) + "\n")
    back = read_results_csv(spark, str(tmp_path / "old.csv")).collect()
    assert [(r["prediction"], r["label"], r["rag_output"]) for r in back] == [
        (64.5, "anomaly", None),
        (0.2, "dos", "one\ntwo"),
        (None, None, None),
    ]


def test_event_times_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT TIMESTAMP_NTZ'2024-07-03 02:30:07.179575' AS ts").select(epoch_us(F.col("ts")))
        assert df.first()[0] == 1_719_973_807_179_575
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
