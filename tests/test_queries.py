"""Every checked query against its SQL twin."""

import pytest

import __spark_entry__ as entry
from lawtide.plans.catalog import QUERIES
from lawtide.plans.twins import TWINS
from oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert difference(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_twins_are_complete():
    assert set(QUERIES) == set(TWINS)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["topic", "lang", "paragraphs", "texts"] and df.count() > 0
