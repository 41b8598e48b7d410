"""Class probabilities and the decision rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.once import computed_once
from flowloom.schemas import (
    FEATURES,
    FIRST_ANOMALIES,
    LABELS,
    NORMAL_INDEX,
    NORMAL_LABEL,
    NORMAL_THRESHOLD,
    quoted,
)


@dataclass(frozen=True)
class LinearScorer:
    """Softmax over one margin per class: weights over the 18 scaled features plus a bias.

    ``prefix`` names the scaled columns when they sit next to the raw ones.
    """

    weights: Sequence[Sequence[float]]
    biases: Sequence[float]
    prefix: str = ""

    def __call__(self, scaled: DataFrame) -> DataFrame:
        names = [quoted(self.prefix + name) for name in FEATURES]
        margins = {
            f"_m{c}": " + ".join(f"({float(w)!r}D) * {name}" for w, name in zip(row, names)) + f" + ({float(bias)!r}D)"
            for c, (row, bias) in enumerate(zip(self.weights, self.biases))
        }
        # Shifted by the largest margin, so that no exponential overflows.
        powers = {f"_e{c}": f"exp({m} - _top)" for c, m in enumerate(margins)}
        stepwise = (
            scaled.selectExpr("*", *[f"{text} AS {name}" for name, text in margins.items()])
            .selectExpr("*", f"greatest({', '.join(margins)}) AS _top")
            .selectExpr("*", *[f"{text} AS {name}" for name, text in powers.items()])
            .selectExpr("*", f"{' + '.join(powers)} AS _total")
        )
        probs = F.expr(f"array({', '.join(f'{name} / _total' for name in powers)})")
        return computed_once(stepwise, {"probs": probs}).drop(*margins, *powers, "_top", "_total")


@dataclass(frozen=True)
class PipelineScorer:
    """A fitted MLlib pipeline that leaves class probabilities in a vector column."""

    model: PipelineModel
    column: str = "probability"

    def __call__(self, scaled: DataFrame) -> DataFrame:
        added = set(self.model.transform(scaled.limit(0)).columns) - set(scaled.columns)
        out = self.model.transform(scaled).withColumn("probs", vector_to_array(self.column))
        return out.drop(*added)


@dataclass(frozen=True)
class BatchScorer:
    """A user model: ``load`` runs once per task, ``predict`` maps an (n, 18) array to (n, 11).

    A row whose prediction fails or has another shape gets all-zero probabilities.
    """

    load: Callable[[], object]
    predict: Callable[[object, object], object]

    def __call__(self, scaled: DataFrame) -> DataFrame:
        schema = T.StructType([*scaled.schema.fields, T.StructField("probs", T.ArrayType(T.DoubleType()))])
        load, predict, width = self.load, self.predict, len(LABELS)

        def several(model, rows: np.ndarray) -> np.ndarray:
            probs = np.asarray(predict(model, rows), dtype=float)
            if probs.shape != (len(rows), width):
                raise ValueError(f"expected {len(rows)} x {width} probabilities, got {probs.shape}")
            return probs

        def one(model, row: np.ndarray) -> np.ndarray:
            try:
                return several(model, row)[0]
            except Exception:
                return np.zeros(width)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                rows = batch[FEATURES].to_numpy(float)
                try:
                    probs = several(model, rows)
                except Exception:
                    probs = [one(model, rows[i : i + 1]) for i in range(len(rows))]
                yield batch.assign(probs=list(probs))

        return scaled.mapInPandas(run, schema)


def label_of(index: Column) -> Column:
    """Class index -> label (J2); eleven labels travel as a literal array."""
    names = F.expr("array({})".format(", ".join(f"'{name}'" for name in LABELS)))
    return F.element_at(names, index + 1)


def argmax(probs: Column) -> Column:
    """Index of the largest value, the lowest one on a tie."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def decide(scored: DataFrame, threshold: float = NORMAL_THRESHOLD) -> DataFrame:
    """P(normal) at or above the threshold wins, else the most probable class (M4).

    All-zero or missing probabilities, any that is not a finite number, and a wrong number
    of them mean that scoring failed: the label is that of index 0 with value 0 and
    ``score_status`` is ``error`` (M5).
    """
    # NaN sorts above every number, so the two ends of the array show whatever is not finite.
    usable = f"size(probs) = {len(LABELS)} AND abs(array_max(probs)) < double('inf') AND abs(array_min(probs)) < double('inf')"
    usable += " AND NOT exists(probs, p -> p IS NULL)"
    scored = scored.withColumn("probs", F.expr(f"if({usable}, probs, array_repeat(0.0D, {len(LABELS)}))"))
    if "score_status" not in scored.columns:
        scored = scored.withColumn("score_status", F.lit("ok"))
    probs = F.col("probs")
    normal = F.element_at(probs, NORMAL_INDEX + 1)
    is_normal = normal >= threshold
    failed = F.array_max(probs) == 0.0
    return scored.withColumns(
        {
            "prediction": F.when(is_normal, normal).otherwise(F.array_max(probs)),
            "label": F.when(is_normal, NORMAL_LABEL).otherwise(label_of(argmax(probs))),
            "score_status": F.when(failed, "error").otherwise(F.col("score_status")),
        }
    )


def anomalies(labelled: DataFrame) -> DataFrame:
    """Rows whose label is not ``normal``."""
    return labelled.where(F.col("label") != NORMAL_LABEL)


def first_anomalies(labelled: DataFrame, order: list[str], n: int = FIRST_ANOMALIES) -> DataFrame:
    """The first ``n`` anomalies in arrival order (W5): each task keeps n rows, then they merge."""
    return anomalies(labelled).orderBy(*order).limit(n)


def label_counts(labelled: DataFrame) -> DataFrame:
    """Rows per label (A13); a partial count per task precedes the shuffle."""
    return labelled.groupBy("label").agg(F.count("*").alias("rows"))


def display_line(labelled: DataFrame, keep: list[str]) -> DataFrame:
    """Upper-case label and the value with six decimals."""
    return labelled.select(
        *keep,
        F.concat(
            F.lit("Prediction: "),
            F.upper("label"),
            F.lit(" (value="),
            F.format_string("%.6f", "prediction"),
            F.lit(")"),
        ).alias("line"),
    )
