"""Segmented scans against plain windows, with a key that holds half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import scans

SCHEMA = "k string, at long, tie long, hit boolean, v double"


def rows(spark, n=4000):
    rng = random.Random(6)
    data = [("hot" if i % 2 else rng.choice(["a", "b", "c", None]), rng.randrange(900), i, rng.random() < 0.02, rng.choice([None, rng.random()])) for i in range(n)]
    return spark.createDataFrame(data + [("once", 1, n, False, None), ("hot", 5, n + 1, None, 2.0)], SCHEMA)


def everything(df):
    order = ["at", "tie"]
    df = scans.running_max(df, "k", "v", order, "top")
    df = scans.previous(df, "k", "v", order, "before")
    return scans.streaks(df, "k", F.col("hit"), order, "streak", "seen")


def brute(data):
    out, state = [], {}
    for r in sorted(data, key=lambda r: (r["at"], r["tie"])):
        top, before, streak, seen, first = state.get(r["k"], (None, None, 0, False, True))
        top = r["v"] if top is None else top if r["v"] is None else max(top, r["v"])
        streak, seen = (0, True) if r["hit"] else (streak + 1, seen)
        out.append((str(r["k"]), r["at"], r["tie"], top, before, streak, seen))
        state[r["k"]] = (top, r["v"], streak, seen, False)
    return sorted(out)


@pytest.mark.parametrize("most", [0, 10**9])
def test_scans_match_a_loop(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "MOST", most)
    df = rows(spark)
    found = sorted((str(r["k"]), r["at"], r["tie"], r["top"], r["before"], r["streak"], r["seen"]) for r in everything(df).collect())
    assert found == brute(df.collect())
    assert everything(df.limit(0)).count() == 0
    assert set(everything(df).columns) == {*df.columns, "top", "before", "streak", "seen"}


def test_hot_key_spreads(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = scans.ranged(rows(spark), "k", ["at", "tie"])
        sizes = [r["count"] for r in cut.groupBy("range_").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
        assert cut.where("k = 'hot'").select("range_").distinct().count() >= 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
