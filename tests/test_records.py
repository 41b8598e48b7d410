import json
import math

import pytest
from pyspark.sql import functions as F

from flowloom.operators.records import (
    dead_letters,
    screen_records,
    stripped,
    validate_and_fill,
    with_nonfinite_flags,
)
from flowloom.operators.schema_check import (
    expected_names,
    name_differences,
    observed_names,
    order_differences,
)
from flowloom.schemas import FEATURES
from flowloom.sources.records import read_corpus, read_lines, write_corpus

FULL = dict.fromkeys(FEATURES, 1)


def line(**changes):
    return json.dumps(FULL | changes)


def raw(text):
    """A record whose first value is the given JSON text."""
    return line(dur="@").replace('"@"', text)


LINES = {
    "plain": (line(), None),
    "seventeen": (json.dumps(dict(list(FULL.items())[:-1])), "feature_count"),
    "nineteen": (line(extra=1), "feature_count"),
    "no names": ("{}", "feature_count"),
    "unknown": (line().replace('"ct_dst_src_ltm"', '"other"'), None),
    "truncated": (line()[:-5], "malformed"),
    "bare nan": (raw("NaN"), "malformed"),
    "array": (json.dumps(list(range(18))), "not_object"),
    "string": ('"eighteen letters!!"', "not_object"),
    "number": ("18", "not_object"),
    "null": ("null", "not_object"),
    "repeated": (line().replace('"ct_dst_src_ltm"', '"dur"'), "duplicate_key"),
    "two records": (line() + line(), "malformed"),
    "trailing text": (line() + " x", "malformed"),
    "closing bracket": (line() + "],[1", "malformed"),
    "closing brace": (line() + '},{"r":1', "malformed"),
    "second value": (line() + ', "k": 1', "malformed"),
    "spaces around": ("  " + line() + " \t", None),
    "single quotes": (line().replace('"', "'"), "malformed"),
}


@pytest.fixture(scope="module")
def screened(spark):
    rows = [(k, v[0]) for k, v in LINES.items()] + [("blank", " \t "), ("empty", "")]
    return screen_records(spark.createDataFrame(rows, "name string, line string")).cache()


def test_reasons(screened):
    got = {r["name"]: r["reason"] for r in screened.collect()}
    assert got == {name: reason for name, (_, reason) in LINES.items()}


def test_good_rows_and_dead_letters_make_up_the_input(screened):
    good = validate_and_fill(screened, ["name"]).count()
    dead = dead_letters(screened)
    assert good + dead.count() == len(LINES)
    assert dead.columns == ["name", "line", "reason"]


VALUES = {
    '"abc"': 0.0,
    "null": 0.0,
    "[1]": 0.0,
    '{"z": 1}': 0.0,
    "true": 1.0,
    "false": 0.0,
    '"true"': 0.0,
    '" 1.5 "': 1.5,
    '"1e3"': 1000.0,
    '"1d"': 0.0,
    '"2.5f"': 0.0,
    '"1_000"': 0.0,
    "-7": -7.0,
    "12345678901234567890": 12345678901234567890.0,
    "1e300": 1e300,
    '"nan"': math.nan,
    '"inf"': math.inf,
    '"-Infinity"': -math.inf,
}


def test_value_coercion(spark):
    rows = [(text, raw(text)) for text in VALUES]
    filled = validate_and_fill(screen_records(spark.createDataFrame(rows, "text string, line string")), ["text"])
    got = {r["text"]: r["dur"] for r in filled.collect()}
    assert got.keys() == VALUES.keys()
    for text, want in VALUES.items():
        assert got[text] == want or (math.isnan(want) and math.isnan(got[text])), text
    assert filled.columns == ["text", *FEATURES]


def test_unknown_names_go_and_missing_ones_are_zero(screened):
    row = validate_and_fill(screened, ["name"]).where("name = 'unknown'").first()
    assert row["ct_dst_src_ltm"] == 0.0
    assert row["ct_src_ ltm"] == 1.0


def test_nonfinite_flags(spark):
    rows = [(1, 1.0, 2.0), (2, math.nan, 1.0), (3, 1.0, -math.inf), (4, None, 1.0)]
    df = with_nonfinite_flags(spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"])
    got = {r["id"]: (r["has_nan"], r["has_inf"]) for r in df.collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, False)}


def test_strip_removes_every_kind_of_white_space(spark):
    df = spark.createDataFrame([("\t a b \r\n",)], "x string").select(stripped(F.col("x")).alias("x"))
    assert df.first()["x"] == "a b"


def test_lines_survive_a_file(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(line(),), ("",), ("oops",)], "value string").write.text(path)
    assert sorted(r["line"] for r in read_lines(spark, path).collect()) == sorted(["", "oops", line()])


def test_corpus_skips_blank_lines_and_allows_missing_labels(spark, tmp_path):
    path = str(tmp_path / "corpus")
    corpus = spark.createDataFrame(
        [(0, "a\nb", "x"), (1, 'say "hi"', None)], "doc_pos long, input string, output string"
    )
    write_corpus(corpus, path)
    spark.createDataFrame([("  ",)], "value string").write.mode("append").text(path)
    assert sorted(map(tuple, read_corpus(spark, path).collect())) == [(0, "a\nb", "x"), (1, 'say "hi"', None)]


def names_of(spark, *records):
    lines = spark.createDataFrame([(json.dumps(r),) for r in records], "line string")
    return observed_names(screen_records(lines))


def check(spark, expected, *records):
    observed = names_of(spark, *records)
    want = expected_names(observed, expected)
    names = {tuple(r) for r in name_differences(want, observed).collect()}
    order = {tuple(r) for r in order_differences(want, observed).collect()}
    return names, order


def test_schema_check(spark):
    assert check(spark, ["a", "b"], {"a": 1, "b": 2}) == (set(), set())
    assert check(spark, ["a", "b"], {"a": 1}) == ({("missing", "b", 0)}, set())
    assert check(spark, ["a"], {"a": 1, "b": 2}) == ({("extra", "b", 1)}, set())
    assert check(spark, ["a", "b"], {"b": 1, "a": 2}, {"b": 1, "a": 2}) == (
        set(),
        {(0, "a", "b", 2), (1, "b", "a", 2)},
    )
