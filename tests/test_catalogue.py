"""Every registered query runs; those with SQL agree with DuckDB."""

import pytest

from siftwright import catalogue

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck, same):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert list(got.columns)
    if name in catalogue.SQL:
        same(got, duck.execute(catalogue.SQL[name]).df())


def test_sql_belongs_to_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
