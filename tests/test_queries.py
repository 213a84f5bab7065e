"""Every registered query of the core against its SQL on the smallest data."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from lodestone.plans import code, search, usage

QUERIES = {k: v for m in (code, search, usage) for k, v in m.queries().items()}
SQL = {k: v for m in (code, search, usage) for k, v in m.oracle_sql().items()}


def normal(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in SQL:
        return
    relation = duck.sql(SQL[name])
    columns = relation.columns
    assert names == sorted(columns)
    want = sorted((tuple(normal(r[columns.index(c)]) for c in names) for r in relation.fetchall()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "score", "rank"]
