"""Every registered query against its SQL over the smallest tables."""

import pytest

import __spark_entry__ as driver
from checks.compare import difference, duck
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLE) <= set(driver.oracle_sql())


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["split", "n_samples", "n_tokens"]
    assert result.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, connection):
    assert ORACLE[name]
    assert difference(name, spark, connection, SF) is None
