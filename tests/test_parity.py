"""Every query with SQL beside it against DuckDB, on the smallest tables."""

import pytest

from tessera.plans.queries import ORACLE, QUERIES

from .parity import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert compare(QUERIES[name](spark, SF), ORACLE[name], SF) == ""


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 30
    assert set(e.oracle_sql()) <= set(e.queries())
