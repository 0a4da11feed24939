"""Every registered core query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, oracle

from foliodex.plans import catalog

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    assert compare(catalog.queries()[name](spark, small), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs_without_sql(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
