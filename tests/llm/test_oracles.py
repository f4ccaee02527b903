"""Queries of this subpackage against their SQL in DuckDB."""

import pytest

from tests.test_queries import SF, duck, normal  # noqa: F401
from tidewell.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    got = queries.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    out = duck.sql(queries.ORACLE_SQL[name])
    assert rows and sorted(out.columns) == sorted(got.columns)
    assert normal(got.columns, rows) == normal(out.columns, out.fetchall())
