"""Every query that has a SQL twin equals it; the contract functions agree."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_module

SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert difference(con, SQL[name], QUERIES[name](spark, sf)) is None


def test_contract(spark):
    assert set(SQL) <= set(QUERIES)
    flagship = entry_module.entry(spark)
    assert flagship.columns == ["hour", "avg_traffic", "avg_aqi", "is_peak", "total_records", "avg_aqi_scaled"]
    assert flagship.count() == 24
