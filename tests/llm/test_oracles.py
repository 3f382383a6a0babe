"""Queries with SQL against it on the smallest tables, and plans without joins by anything but equality."""

import duckdb
import pytest

from vellum import llm

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.parametrize("name", ["op11_tries", "op12_curve", "op13_phrases"])
def test_query(spark, name):
    df = llm.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and not any(x in df._jdf.queryExecution().executedPlan().toString() for x in FORBIDDEN)
    if sql := llm.oracle_sql().get(name):
        con = duckdb.connect()
        for table in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(str(r) for r in found.fetchall())


def test_packing_of_a_table(spark):
    rows = llm.queries()["op12_curve"](spark, SF).collect()
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(docs) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for pieces in docs.values():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == total
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        assert at <= 4096
    assert padding == 0
