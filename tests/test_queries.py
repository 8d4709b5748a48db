"""Every registered query: the same rows as its SQL, or rows with a stable schema."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare
from tidewire.plans import all_queries, registry  # noqa: F401


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    compare(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert df.columns
    assert df.count() > 0
