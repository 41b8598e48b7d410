"""Every named query against its SQL twin on the smallest test set."""

import os

import compare
import pytest

import __spark_entry__ as entry
from flowloom.plans.catalog import QUERIES
from flowloom.schemas import FEATURES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, db, name):
    assert compare.compare(spark, db, SF_DIR, name) is None


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[-len(FEATURES) :] == FEATURES
    assert df.limit(1).count() == 1
