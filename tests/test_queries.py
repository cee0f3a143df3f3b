"""Every registered query with SQL gives DuckDB's rows on the same tables; the others run."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, int, datetime.date)):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return [plain(v) for v in x]


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith(("op", "pipeline"))))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
