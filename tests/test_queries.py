"""Every registered query against its SQL, on the whole tables."""

import pytest

import oracle
from conftest import DATA
from listingflow import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, con, data, name):
    assert name in catalog.ORACLE
    difference, rows = oracle.compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], data)
    assert difference is None
    assert rows > 0
