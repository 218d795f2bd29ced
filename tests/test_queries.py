"""Every registered query against its DuckDB twin, and the driver contract."""

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_module
from foliospark.plans import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    q = QUERIES[name]
    got = q.plan(spark, SF_DIR).toPandas()
    if q.sql is None:
        assert len(got) > 0
        return
    assert difference(got, duck.execute(q.sql).df()) is None


def test_contract(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
