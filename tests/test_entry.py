"""Every registered query against its oracle on the smallest tables, and the shape of their plans."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_
from vellum import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Joins by a condition that is no equality: none of the library's queries needs one.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in FORBIDDEN)
    if sql := catalog.oracle_sql().get(name):
        found = duck.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        expected = sorted(tuple(str(plain(v)) for _, v in sorted(zip(columns, r))) for r in found.fetchall())
        assert sorted(tuple(str(plain(r[c])) for c in sorted(columns)) for r in rows) == expected


def test_entry_runs(spark):
    df = entry_.entry(spark)
    assert df.count() > 0 and df.columns == ["source", "lang", "n_docs"]


def test_names_agree():
    assert set(entry_.oracle_sql()) <= set(entry_.queries())
    assert set(catalog.queries()) <= set(entry_.queries())
