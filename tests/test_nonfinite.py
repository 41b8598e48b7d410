"""Values that are not finite, from a record to its stored row."""

import math

import numpy as np
import pytest

from flowloom.functions.text import query_string
from flowloom.operators.records import screen_records, validate_and_fill
from flowloom.operators.scaling import fit_scaler, scale
from flowloom.operators.scoring import BatchScorer, decide
from flowloom.plans.scoring import label_rows
from flowloom.schemas import FEATURES, LABELS
from flowloom.sources.results import append_results, result_rows, stored_rows

NAN, INF = float("nan"), float("inf")


def probs(**at):
    row = [0.0] * len(LABELS)
    for place, value in at.items():
        row[int(place[1:])] = value
    return row


@pytest.mark.parametrize(
    "row",
    [probs(p7=NAN), probs(p3=NAN, p7=0.9), [NAN] * 11, probs(p2=INF), probs(p2=-INF, p7=0.5), None, [0.5, 0.5], [0.0] * 11, [None] + [0.1] * 10],
)
def test_a_failed_prediction_is_never_normal(spark, row):
    df = spark.createDataFrame([(1, row)], "id long, probs array<double>")
    r = decide(df).first()
    assert (r["label"], r["prediction"], r["score_status"]) == (LABELS[0], 0.0, "error")


def test_scaler_leaves_out_what_is_not_finite(spark):
    rows = [(1.0, 5.0), (3.0, NAN), (INF, 5.0), (None, -INF), (5.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    scaler = fit_scaler(df, ["a", "b"])
    assert scaler.means == (3.0, 5.0)
    assert scaler.scales == (pytest.approx(math.sqrt(8 / 3)), 1.0)
    assert scaler.left_out == (2, 2)
    assert scale(df, scaler).count() == 5


@pytest.mark.parametrize("rows", [[], [(NAN, 1.0)], [(None, 1.0), (INF, 2.0)]])
def test_scaler_needs_a_finite_value(spark, rows):
    with pytest.raises(ValueError, match="a"):
        fit_scaler(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])


def features(spark, **odd):
    row = {f: 1.0 for f in FEATURES} | odd
    return spark.createDataFrame([(7, *[row[f] for f in FEATURES])], "row_id long, " + ", ".join(f"`{f}` double" for f in FEATURES))


def test_texts_name_what_is_not_finite(spark):
    text = features(spark, dur=NAN, sbytes=INF, Sload=-INF, swin=NAN).select(query_string()).first()[0]
    parts = dict(p.split(": ") for p in text.split(" | "))
    assert len(parts) == len(FEATURES)
    assert (parts["dur"], parts["sbytes"], parts["Sload"], parts["swin"], parts["Sjit"]) == ("nan", "inf", "-inf", "nan", "1.000000")


def test_texts_round_without_a_bias(spark):
    text = features(spark, dur=0.0000004999).select(query_string()).first()[0]
    assert text.startswith("dur: 0.000000 ")


def test_stored_rows_hold_null_for_what_an_integer_cannot(spark, tmp_path):
    rows = stored_rows(features(spark, sbytes=INF, swin=NAN, dbytes=1e30, dur=INF))
    append_results(rows, str(tmp_path / "t"))
    r = spark.read.parquet(str(tmp_path / "t")).first()
    assert (r["sbytes"], r["swin"], r["dbytes"], r["dur"], r["row_id"]) == (None, None, None, INF, 7)


def test_one_odd_record_does_not_end_the_job(spark):
    names = ", ".join(f'"{f}": {v}' for f, v in zip(FEATURES, ['"nan"', '"inf"', '"0x1p3"', *["2"] * 15]))
    plain = ", ".join(f'"{f}": {i}' for i, f in enumerate(FEATURES))
    lines = spark.createDataFrame([(1, "{" + names + "}"), (2, "{" + plain + "}")], "row_id long, line string")
    filled = validate_and_fill(screen_records(lines), ["row_id"])
    labelled = label_rows(filled, fit_scaler(filled, FEATURES))
    got = {r["row_id"]: r for r in labelled.collect()}
    assert got[1]["score_status"] == "error" and got[1]["label"] == LABELS[0]
    assert got[2]["score_status"] == "ok"
    assert got[1]["dbytes"] == 0.0  # hexadecimal text is no number
    assert {r["row_id"] for r in result_rows(labelled).collect()} == {1, 2}


def test_scoring_without_a_scaler(spark):
    r = label_rows(features(spark), None).first()
    assert r["score_status"] == "unscaled" and 0 < r["prediction"] <= 1


def test_predictions_of_another_shape_fail(spark):
    scorer = BatchScorer(lambda: None, lambda _, rows: np.ones((len(rows), 3)))
    assert decide(scorer(features(spark))).first()["score_status"] == "error"
