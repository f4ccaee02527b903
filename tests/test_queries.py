"""Every query with SQL against DuckDB on the same tables; the rest must give rows."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from tidewell import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.6g}" if x else "0"
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.6g}" if abs(x) > 2**53 else str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return str(x)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    assert rows, "a query without rows shows nothing"
    if sql := catalogue.ORACLE_SQL.get(name):
        out = duck.sql(sql)
        assert sorted(out.columns) == sorted(got.columns)
        a, b = normal(got.columns, rows), normal(out.columns, out.fetchall())
        assert len(a) == len(b) and a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]
