"""Every query runs; those with SQL give what the SQL gives."""

import pytest

import __spark_entry__ as entry
from corpusloom.plans import registry
from tests.oracle import assert_same, connect


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "target", "weight", "origins"]
    assert df.limit(1).count() == 1


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
    else:
        assert_same(got, connect(sf).execute(sql).df())
