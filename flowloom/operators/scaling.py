"""Standard scaling with population deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.schemas import quoted


@dataclass(frozen=True)
class Scaler:
    """Mean and scale per named column, in fit order, and how many values the fit left out."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    left_out: tuple[int, ...] = ()

    def column(self, name: str) -> Column:
        """``(x - mean) / scale`` of one column, found by name."""
        i = self.names.index(name)
        return F.expr(f"(CAST({quoted(name)} AS DOUBLE) - ({self.means[i]!r}D)) / ({self.scales[i]!r}D)")

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, i, mean, scale)
            for i, (name, mean, scale) in enumerate(zip(self.names, self.means, self.scales))
        ]
        return spark.createDataFrame(rows, "feature string, position int, mean double, scale double")

    @staticmethod
    def from_frame(df: DataFrame) -> Scaler:
        """One row per feature, so collecting it is bounded by the column count."""
        rows = df.orderBy("position").collect()
        return Scaler(
            tuple(r["feature"] for r in rows),
            tuple(r["mean"] for r in rows),
            tuple(r["scale"] for r in rows),
        )


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """Mean and population deviation of every column in one pass; a constant gets scale 1.

    Missing and non-finite values are left out and counted per column; a column without any
    finite value cannot be fitted.
    """
    values = [F.col(quoted(c)).cast("double") for c in columns]
    cols = [F.when(F.abs(c) < float("inf"), c) for c in values]
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.count_if(c.isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
    ).first()
    n = len(columns)
    empty = [name for name, mean in zip(columns, row[:n]) if mean is None]
    if empty:
        raise ValueError(f"cannot fit a scaler without finite values: {', '.join(empty)}")
    scales = tuple(1.0 if s == 0 else float(s) for s in row[n : 2 * n])
    return Scaler(tuple(columns), tuple(float(m) for m in row[:n]), scales, tuple(row[2 * n :]))


def scale(df: DataFrame, scaler: Scaler | None) -> DataFrame:
    """Replace the scaler's columns by scaled doubles; without a scaler pass through (M2).

    ``score_status`` says whether the row was scaled, so unscaled rows never mix in.
    Means and scales are literals, so the step stays inside code generation.
    """
    if scaler is None:
        return df.withColumn("score_status", F.lit("unscaled"))
    missing = [name for name in scaler.names if name not in df.columns]
    if missing:
        return df.withColumn("score_status", F.lit("unscaled"))
    return df.select(
        *[
            scaler.column(c).alias(c) if c in scaler.names else F.col(quoted(c))
            for c in df.columns
        ],
        F.lit("ok").alias("score_status"),
    )


def drift_report(scaled: DataFrame, columns: list[str], limit: float = 4.0) -> DataFrame:
    """Share of rows whose absolute scaled value exceeds ``limit``, per column."""
    n = len(columns)
    wide = scaled.agg(
        *[
            F.avg(F.when(F.abs(F.col(quoted(c))) > limit, 1.0).otherwise(0.0)).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = ", ".join(f"'{c}', c{i}" for i, c in enumerate(columns))
    return wide.select(F.expr(f"stack({n}, {rows}) as (feature, share)"))
