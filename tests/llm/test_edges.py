"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns in every operator."""

import pytest
from pyspark.sql import functions as F

from vellum.llm import op1_pieces, op2_topk, op3_flac, op4_dedup, op5_mix, op6_wavelet, op7_html, op8_pii, op9_toxic, op10_secrets

LONG = "word other thing " * 20_000
ROWS = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "one two three four five six", "b"),
    (3, "one two three four five six", "b"),
    (4, "One TWO three four five six", None),
    (5, LONG, "b"),
    (None, "no id here at all today", "c"),
    (6, "x" * 5000, "a"),
    (7, " \t\n ", "a"),
]
#: Names that operators use inside.
EXTRA = ("id", "ids", "size", "key", "u", "rank", "spans", "score", "n", "v", "host", "drop", "component_id")


def table(spark, rows=ROWS):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.withColumns({c: F.lit(None).cast("string") for c in EXTRA})


def mixed(docs):
    return op5_mix.mix(docs, "doc_id", op5_mix.words(F.col("text")), F.col("source"), same=F.col("text"))[0]


def shards(docs):
    return op6_wavelet.read_documents(op6_wavelet.write_shards(docs)).withColumnRenamed("id", "doc_id")


def scores(docs):
    model = op9_toxic.fit(["you idiot", "a fine day", "idiot again", "good day to all"] * 3, __import__("numpy").array([1, 0, 1, 0] * 3), 0.5)
    return op9_toxic.scored(docs, model)


RUNS = {"op1": op1_pieces.digest, "op3": op3_flac.digest, "op4": op4_dedup.near_duplicates, "op5": mixed, "op6": shards, "op8": op8_pii.find, "op9": scores, "op10": op10_secrets.find}


@pytest.mark.parametrize("name", RUNS)
def test_rows_stay(spark, name):
    found = RUNS[name](table(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ROWS)
    for a, b in ((1, 2),):  # null and empty texts alike
        x, y = ([tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "component_id", "start", "key")) for r in found if r["doc_id"] == i] for i in (a, b))
        assert x == y


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](table(spark, [])).count() == 0


def test_dedup_results(spark):
    found = {r["doc_id"]: r for r in op4_dedup.near_duplicates(table(spark)).collect()}
    assert (found[4]["component_id"], found[4]["kept"], found[3]["component_id"], found[3]["kept"]) == (3, False, 3, True)
    assert (found[1]["n_shingles"], found[1]["component_id"], found[7]["n_shingles"]) == (0, 1, 0)
    assert (found[None]["component_id"], found[None]["kept"]) == (None, False)


def test_topk_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (50, [0.5, 2.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [9.0, 9.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in EXTRA})
    found = {}
    for r in op2_topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=2).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found[0]) == [(1, 1, 65536), (2, 2, 65536), (3, 2, 65536), (4, 50, 32768)]
    assert [x[1] for x in sorted(found[50])] == [0, 1, 2, 2]
    assert op2_topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_html_edges(spark):
    rows = [(1, None, None), (2, "http://a.b/", ""), (2, "http://a.b/", ""), (None, "x", "<p>a  b</p>c"), (3, "http://h/", "<article><p>x&nbsp;y</p><nav>m</nav><br></article>tail")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("q") for c in EXTRA})
    found = {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in op7_html.main_text(df).collect()}
    assert found == {(1, None, "", 0), (2, "http://a.b/", "", 0), (None, "x", "a b c", 5), (3, "http://h/", "x y", 3)}
    assert op7_html.main_text(df.limit(0)).count() == 0


def test_redaction_keeps_columns(spark):
    df = table(spark, [(1, "mail a.b@c.de now", "s"), (2, None, "s")])
    found = op8_pii.redact(df)
    assert found.columns == df.columns
    assert [r["text"] for r in found.orderBy("doc_id").collect()] == ["mail <EMAIL> now", None]


def test_topk_rounds_and_overflow(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.integers(-9, 9, (400, 3)).tolist()
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    found = {}
    for r in op2_topk.top_k(df, F.col("vec_id") % 50 == 0, scale=1, shard_rows=20).collect():  # 20 shards, three rounds
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 400, 50):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[j])), j) for j in range(400) if j != q)[:5]
        assert sorted(found[q]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    far = spark.createDataFrame([(i, [1e12, 1e12]) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        op2_topk.top_k(far, F.lit(True), scale=256).collect()
