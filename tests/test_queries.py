"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from compare import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    found = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert found is None, found


def test_sql_is_given_for_registered_queries_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["channel_ref", "videos", "views", "seconds"]
    assert df.count() > 0
