"""Every query of the core against its DuckDB statement, and those without one for their shape."""

from __future__ import annotations

import pytest

from parchemin import catalog
from tests import duck

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def base(tables):
    return duck.connection(tables)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert catalog.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_statement(spark, tables, base, name):
    duck.same(QUERIES[name](spark, tables), base, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, tables, name):
    df = QUERIES[name](spark, tables)
    assert df.columns and df.count() > 0
