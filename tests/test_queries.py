"""Every registered query against its SQL in DuckDB."""

import pytest

from compare import rows
from skein.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf, duck):
    got = registry.queries()[name](spark, sf).toPandas()
    assert rows(got) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
