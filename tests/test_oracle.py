"""Every registered query with SQL gives the rows that DuckDB gives."""

import compare
import pytest

from hindsail.plans.oracle import ORACLE
from hindsail.plans.queries import QUERIES, entry


@pytest.fixture(scope="module")
def con(small):
    return compare.connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_equal(spark, small, con, name):
    assert compare.differences(QUERIES[name](spark, small), ORACLE[name], con) == []


def test_entry(spark, small):
    rows = entry(spark, small).collect()
    assert rows and {r.status for r in rows} <= {"ok", "insufficient_data", "insufficient_resolved_analogs"}


def test_driver_entry_lists_plans():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
