"""Every registered query of the subpackage against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, oracle

from foliodex.llm import queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return oracle(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, con, name):
    assert compare(queries.queries()[name](spark, small), con, SQL[name]) == ""


COLUMNS = {"p3_found": ["file_a", "file_b"], "p4_found": ["file_id", "line_no", "kind"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id"], "p8_found": ["doc_id", "span_start", "span_end"]}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, small, name):
    df = queries.queries()[name](spark, small)
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0


def test_found_pairs_are_in_order(spark, small):
    assert queries.p3_found(spark, small).where("file_a >= file_b").count() == 0
