"""Keep costly expressions from being evaluated more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions later filters do not repeat.

    A filter on a derived column is normally pushed below its projection by copying the
    expression, which then runs twice and makes plans grow.  Filters stay above a
    generator, so the columns come out of a generator of exactly one row.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.drop(*columns).select("*", F.inline(F.array(row)))
