"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import connect, difference


@pytest.fixture(scope="module")
def database(sf_small):
    return connect(sf_small)


def test_entry(spark):
    assert entry(spark).count() == 3


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, database, sf_small, name):
    found = queries()[name](spark, sf_small).toPandas()
    assert len(found)
    if name in oracle_sql():
        assert difference(found, database.execute(oracle_sql()[name]).df()) is None
