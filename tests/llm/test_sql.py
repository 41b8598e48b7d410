"""Training-data queries against their SQL twins on the smallest test set."""

import os

import compare
import pytest

import __spark_entry__ as entry
from flowloom.llm.oracles import ORACLES
from flowloom.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, db, name):
    assert compare.compare(spark, db, SF_DIR, name) is None


def test_all_are_registered():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
