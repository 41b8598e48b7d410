"""JSON feature records: screening, validation and dead letters."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.once import computed_once
from flowloom.schemas import FEATURES, quoted

MALFORMED = "malformed"
DUPLICATE_KEY = "duplicate_key"
NOT_OBJECT = "not_object"
FEATURE_COUNT = "feature_count"


def stripped(text: Column) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# One pair of braces that closes at the end: nothing can follow the object.
_PLAIN_OBJECT = r"^\s*\{[^{}]*\}\s*$"


def screen_records(lines: DataFrame) -> DataFrame:
    """Add ``reason``: null for an acceptable record, else why it is refused.

    Blank lines are not records and disappear (P7).  The parser stops after the first
    value, so text behind it must be found otherwise: a plain object has no room for any;
    every other line is parsed once inside an array and once inside an object, and only a
    lone value fits both.
    """
    line = F.col("line")
    in_array = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))).isNotNull()
    in_object = F.json_object_keys(F.concat(F.lit('{"r":'), line, F.lit("}"))).isNotNull()
    repeated = F.size("keys") != F.size(F.array_distinct("keys"))
    parsed = computed_once(
        lines.where(line.rlike(r"\S")),
        {
            "keys": F.json_object_keys(line),
            "value": F.try_parse_json(line),
            "_lone": line.rlike(_PLAIN_OBJECT) | (in_array & in_object),
        },
    )
    return parsed.withColumn(
        "reason",
        F.when(~F.col("_lone"), MALFORMED)
        .when(repeated, DUPLICATE_KEY)
        .when(F.col("value").isNull(), MALFORMED)
        .when(F.col("keys").isNull(), NOT_OBJECT)
        .when(F.size("keys") != len(FEATURES), FEATURE_COUNT),
    ).drop("_lone")


def dead_letters(screened: DataFrame) -> DataFrame:
    """Refused records with their reason; with the accepted ones they make up the input."""
    return screened.where(F.col("reason").isNotNull()).drop("keys", "value")


def _fields(kind: str) -> str:
    return "struct<{}>".format(", ".join(f"{quoted(name)}: {kind}" for name in FEATURES))


def validate_and_fill(screened: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Accepted records as 18 doubles in fixed order.

    Numbers and booleans stay, numeric text is converted, anything else is 0; unknown names
    go, missing ones are 0.  The engine also reads "1d" and "1f" as numbers, which a record
    means as text, and reads hexadecimal text; the texts are looked at only in lines that
    could hold such a value.
    """
    good = screened.where(F.col("reason").isNull())
    value = F.col("value")
    suspect = F.col("line").rlike(r'[0-9.][dDfF]\s*"|0[xX]|\\')
    read = computed_once(
        good,
        {
            "_numbers": F.try_variant_get(value, "$", _fields("double")),
            "_texts": F.when(suspect, F.try_variant_get(value, "$", _fields("string"))),
        },
    )
    filled = [
        f"if(coalesce(_texts.{f} RLIKE '[0-9.][dDfF][ ]*$|0[xX]', false), 0D, coalesce(_numbers.{f}, 0D)) AS {f}"
        for f in map(quoted, FEATURES)
    ]
    return read.selectExpr(*(keep or []), *filled)


def with_nonfinite_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``has_nan`` and ``has_inf`` over the given columns (P10)."""
    cols = [F.col(quoted(c)).cast("double") for c in columns]
    infinity = F.lit(float("inf"))
    return df.withColumns(
        {
            "has_nan": reduce(or_, [F.coalesce(F.isnan(c), F.lit(False)) for c in cols]),
            "has_inf": reduce(or_, [F.coalesce(F.abs(c) == infinity, F.lit(False)) for c in cols]),
        }
    )
