"""Clusters by a judge: small groups as one question, large ones in blocks that meet."""

import random

from pyspark.sql import functions as F

from vellum.operators import clusters, rollup, scans

KIND = "g string, id long, value string"


def by_last():
    def judge(category, values):  # nested, so that it travels by value
        groups = {}
        for i, v in enumerate(values):
            groups.setdefault(v.split()[-1], []).append(i)
        return list(groups.values())

    return judge


def clustered(df, judge, size):
    rows = df.withColumn("category", F.lit("c"))
    return {r["id"]: r["cluster"] for r in clusters.judged(rows, ["g", "category"], judge, "category", size).collect()}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long")
    assert {r["node"]: r["component"] for r in clusters.components(df).collect()} == {x: root(x) for x in list(parent)}
    assert clusters.components(df.limit(0)).count() == 0


def test_blocks_give_what_one_question_gives(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("big", i, f"item {rng.randrange(1000)} kind{i % 7}") for i in range(300)] + [("small", 1000, "a x"), ("small", 1001, "b x"), ("one", 2000, "a x"), ("big", 3000, None)]
    rows = [r if r[2] else (r[0], r[1], "--") for r in rows]
    judge, df = by_last(), spark.createDataFrame(rows, KIND)
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r[1], r[2]) for r in rows if r[0] == g)
        first = {}
        for i, v in own:
            want[i] = first.setdefault(v.split()[-1], i)
    assert clustered(df, judge, 1000) == want == clustered(df, judge, 10)
    sizes = clusters.blocks(df.withColumn("n", F.lit(300)), ["g"], 10).groupBy("g", "word", "range_", "slot").count()
    assert sizes.agg(F.max("count")).first()[0] <= 10
    monkeypatch.setattr(scans, "MOST", 0)  # blocks in ranges
    found = clustered(df, judge, 10)
    assert all(rows_of(found, want, i) for i in want)


def rows_of(found, want, i):
    """Ranges may part a cluster, but join no two."""
    return want[found[i]] == want[i]


def test_a_judge_that_fails_loses_nothing(spark):
    def broken(category, values):
        raise RuntimeError("no answer")

    df = spark.createDataFrame([("g", 1, "a x"), ("g", 2, "b x")], KIND)
    assert clustered(df, broken, 10) == {1: 1, 2: 2}
    assert clustered(df, lambda c, v: [[0, 0, 9, 1]], 10) == {1: 1, 2: 1}
    assert clustered(df.limit(0), broken, 10) == {}


def test_groups_share_a_call_of_python(spark):
    """Groups that end within, at and beyond a batch; the judge sees each whole and in order."""
    sizes = [1, 3, 25, 7, 60, 2, 10, 10, 1]
    rows = [(p, f"c{p}", f"v{i:03d} w{i % 3}", f"n{i}", i) for p, n in enumerate(sizes) for i in range(n)]
    own = spark.createDataFrame(rows, "product_id long, category string, value string, normalized_value string, seq long")

    def judge(category, values):
        if values != sorted(values) or len(values) != sizes[int(category[1:])]:
            raise ValueError(category)
        return [[i for i in range(len(values)) if i % 3 == k] for k in range(3)]

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 10)
    try:
        got = rollup.cluster(own, judge)
        assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
        assert got.where(F.col("cluster") != F.col("seq") % 3).count() == 0 and got.count() == sum(sizes)
    finally:
        spark.conf.set(name, before)


def test_findings_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        read.add(1)
        return value

    rows = [(i % 2, clusters.NARRATIVE[0], f"v{i} w{i % 3}", f"v{i} w{i % 3}", i) for i in range(40)]
    found = spark.createDataFrame(rows, "product_id long, category string, value string, normalized_value string, seq long").withColumn("value", counted.asNondeterministic()("value"))
    got = clusters.consolidate(rollup.first_items(found), by_last(), clusters.NARRATIVE, size=8)
    assert got.groupBy("product_id", "cluster").count().count() == 6 and read.value == len(rows)
