"""Every registered query runs at the smallest scale; those with SQL equal it."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from loomwright.plans import catalog


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str([norm(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def equal_to_sql(spark, data, query, sql):
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert cols == sorted(names)
    assert got == sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, name):
    equal_to_sql(spark, data, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, data, name):
    df = catalog.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
