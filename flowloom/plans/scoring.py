"""Features -> scaled -> probabilities -> label, as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.records import validate_and_fill
from flowloom.operators.scaling import Scaler, fit_scaler
from flowloom.operators.scoring import LinearScorer, decide
from flowloom.schemas import FEATURES, LABELS
from flowloom.session import materialise

PREFIX = "z_"


def demo_scorer(prefix: str = PREFIX) -> LinearScorer:
    """A linear model given by a rule, so that results can be checked in plain SQL."""
    weights = [
        [((c * 7 + j * 3) % 11 - 5) / 10 for j in range(len(FEATURES))] for c in range(len(LABELS))
    ]
    return LinearScorer(weights, [(c % 4) / 10 for c in range(len(LABELS))], prefix)


def with_scaled(features: DataFrame, scaler: Scaler) -> DataFrame:
    """Put scaled features next to the raw ones as ``z_`` columns."""
    return features.withColumns({PREFIX + name: scaler.column(name) for name in scaler.names})


def label_rows(
    features: DataFrame,
    scaler: Scaler | None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Scale, score and decide; nothing here shuffles.

    Without a scaler the features are scored as they are, and ``score_status`` is ``unscaled``.
    """
    if scaler is None:
        return decide((scorer or demo_scorer(""))(features.withColumn("score_status", F.lit("unscaled"))))
    return decide((scorer or demo_scorer())(with_scaled(features, scaler)))


def fit_and_label(features: DataFrame) -> DataFrame:
    """Fit the scaler on the features themselves, then label them.

    The features are stored once, because fitting and scoring both read them.
    """
    stored = materialise(features)
    return label_rows(stored, fit_scaler(stored, FEATURES))


def record_scorer(scaler: Scaler | None) -> Callable[[DataFrame], DataFrame]:
    """Screened JSON records -> labelled feature rows, for tables and micro-batches alike."""

    def score(screened: DataFrame) -> DataFrame:
        keep = [c for c in screened.columns if c not in ("line", "keys", "value", "reason")]
        labelled = label_rows(validate_and_fill(screened, keep), scaler)
        return labelled.select(
            *keep, *[F.col(f"`{f}`") for f in FEATURES], "prediction", "label", "score_status"
        )

    return score
