import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowloom.operators.scaling import Scaler, drift_report, fit_scaler, scale
from flowloom.operators.scoring import (
    BatchScorer,
    LinearScorer,
    PipelineScorer,
    anomalies,
    argmax,
    decide,
    display_line,
    first_anomalies,
    label_counts,
    label_of,
)
from flowloom.schemas import FEATURES, LABELS


def probs_frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, probs array<double>")


def spread(**at):
    """A probability vector with the given values by label."""
    return [float(at.get(name, 0.0)) for name in LABELS]


def test_scaler_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (6.0, 5)], "x double, y int")
    scaler = fit_scaler(df, ["x", "y"])
    assert scaler.means == (3.0, 5.0)
    assert scaler.scales[0] == pytest.approx(math.sqrt(14 / 3))
    assert scaler.scales[1] == 1.0  # constant column


def test_scaler_finds_columns_by_name(spark):
    df = spark.createDataFrame([(1.0, 10.0, "a")], "y double, x double, tag string")
    out = scale(df, Scaler(("x", "y"), (4.0, 0.0), (2.0, 1.0))).first()
    assert (out["x"], out["y"], out["tag"], out["score_status"]) == (3.0, 1.0, "a", "ok")


def test_without_scaler_rows_pass_through_and_say_so(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert scale(df, None).first()[:] == (1.0, "unscaled")
    assert scale(df, Scaler(("missing",), (0.0,), (1.0,))).first()[:] == (1.0, "unscaled")


def test_scaler_survives_a_table(spark):
    scaler = Scaler(("b", "a"), (1.0, 2.0), (3.0, 4.0))
    assert Scaler.from_frame(scaler.to_frame(spark).repartition(3)) == scaler


def test_empty_table_cannot_be_fitted(spark):
    with pytest.raises(ValueError):
        fit_scaler(spark.createDataFrame([], "x double"), ["x"])


# Recovered from recorded pairs of raw and scaled values: the transform is affine.
def test_recorded_scaling(spark):
    scaler = Scaler(("dur", "sbytes"), (-4.305180, 6.971409), (2.269173, 1.248222))
    df = spark.createDataFrame([(0.001, 119)], "dur double, sbytes long")
    out = scale(df, scaler).first()
    assert out["dur"] == pytest.approx((0.001 + 4.305180) / 2.269173)
    assert out["sbytes"] == pytest.approx((119 - 6.971409) / 1.248222)


def test_drift_report(spark):
    df = spark.createDataFrame([(5.0, 0.0), (-4.5, 4.0), (1.0, 0.0), (0.0, 0.0)], "a double, b double")
    assert {r["feature"]: r["share"] for r in drift_report(df, ["a", "b"]).collect()} == {"a": 0.5, "b": 0.0}


DECISIONS = [
    (spread(normal=0.15, dos=0.85), 0.15, "normal", "ok"),
    (spread(normal=0.1499, dos=0.8501), 0.8501, "dos", "ok"),
    (spread(worms=0.4, exploits=0.4, normal=0.1), 0.4, "exploits", "ok"),
    (spread(backdoor=0.4, backdoors=0.41), 0.41, "backdoors", "ok"),
    (spread(), 0.0, "analysis", "error"),
    (None, 0.0, "analysis", "error"),
]


def test_decision_rule(spark):
    rows = [(i, probs) for i, (probs, *_) in enumerate(DECISIONS)]
    out = decide(probs_frame(spark, rows)).orderBy("row_id").collect()
    for row, (_, value, label, status) in zip(out, DECISIONS):
        assert (row["prediction"], row["label"], row["score_status"]) == (value, label, status)


def test_argmax_takes_the_first_of_equal_values(spark):
    df = probs_frame(spark, [(1, [0.2, 0.5, 0.5])]).select(argmax(F.col("probs")).alias("i"))
    assert df.first()["i"] == 1
    assert df.select(label_of(F.col("i"))).first()[0] == "backdoor"


def scaled_frame(spark, rows):
    return spark.createDataFrame(
        [(i, *map(float, r)) for i, r in enumerate(rows)],
        "row_id long, " + ", ".join(f"`{f}` double" for f in FEATURES),
    )


def linear_case():
    rng = np.random.default_rng(3)
    return rng.normal(size=(40, 18)), rng.normal(size=(11, 18)), rng.normal(size=11)


def softmax(margins):
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_linear_scorer_equals_numpy(spark):
    x, w, b = linear_case()
    out = LinearScorer(w.tolist(), b.tolist())(scaled_frame(spark, x)).orderBy("row_id").collect()
    assert np.allclose([r["probs"] for r in out], softmax(x @ w.T + b))


def test_large_margins_do_not_overflow(spark):
    x, w, b = linear_case()
    out = LinearScorer((w * 1e4).tolist(), b.tolist())(scaled_frame(spark, x)).collect()
    assert all(sum(r["probs"]) == pytest.approx(1.0) for r in out)


def test_user_model_runs_in_batches_and_survives_failures(spark):
    x, w, b = linear_case()
    x[7, 0] = 1000.0

    def predict(model, rows):
        if (rows[:, 0] > 100).any():
            raise RuntimeError("cannot score")
        return softmax(rows @ model.T + b)

    scored = BatchScorer(lambda: w, predict)(scaled_frame(spark, x))
    out = decide(scored).orderBy("row_id").collect()
    assert [r["row_id"] for r in out if r["score_status"] == "error"] == [7]
    good = [i for i in range(len(x)) if i != 7]
    assert np.allclose([out[i]["probs"] for i in good], softmax(x[good] @ w.T + b))


def labelled(spark, labels):
    rows = [(i, i * 10, name, 0.5) for i, name in enumerate(labels)]
    return spark.createDataFrame(rows, "row_id long, ts_us long, label string, prediction double")


def test_first_anomalies_are_global_and_ordered(spark):
    df = labelled(spark, ["normal", "dos", "worms", "normal", "dos", "generic"]).repartition(4)
    assert sorted(r["row_id"] for r in first_anomalies(df, ["ts_us", "row_id"]).collect()) == [1, 2, 4]
    plan = first_anomalies(df, ["ts_us", "row_id"])._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_label_counts_and_anomalies(spark):
    df = labelled(spark, ["normal", "dos", "dos"])
    assert {r["label"]: r["rows"] for r in label_counts(df).collect()} == {"normal": 1, "dos": 2}
    assert anomalies(df).count() == 2


def test_display_line(spark):
    assert display_line(labelled(spark, ["dos"]), []).first()["line"] == "Prediction: DOS (value=0.500000)"


def test_mllib_pipeline_gives_probabilities(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal(3 * (i % 3))), float(rng.normal(-3 * (i % 3))), float(i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double, class double")
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=["x", "y"], outputCol="inputs"),
            LogisticRegression(featuresCol="inputs", labelCol="class", family="multinomial"),
        ]
    ).fit(df)
    scored = PipelineScorer(model)(df)
    assert scored.columns == [*df.columns, "probs"]
    out = scored.select("class", "probs", argmax(F.col("probs")).alias("best")).collect()
    assert all(sum(r["probs"]) == pytest.approx(1.0) for r in out)
    assert sum(r["best"] == r["class"] for r in out) > 130
