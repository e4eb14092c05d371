"""Every registered query runs; those with SQL agree with it, row for row."""

from __future__ import annotations

import pytest
from conftest import rows_of

from quarrymill import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows_of(got) == rows_of(duck.sql(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
