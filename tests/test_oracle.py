"""Every query with a SQL twin gives the twin's rows on DuckDB."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.7g}"
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return str(v)
    return f"{v:.7g}" if isinstance(v, int) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


SQL = driver.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_twin(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    got = duck.execute(SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    want = got.fetchall()
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    other = rows_of(names, want)
    assert len(mine) == len(other)
    wrong = [(a, b) for a, b in zip(mine, other) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
