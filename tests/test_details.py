"""Chunks, keys, quotes, providers, citations and merges."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.operators import chunks, evidence, findings, keys, logs, merge, products, providers, quotes
from vellum.sources import pages


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 80))
def test_chunks_lose_nothing(text, size):
    parts = chunks.chunk(text, size, 5)
    assert all(p.strip() and len(p) <= size for p in parts)
    assert sum(c == "a" for c in text) <= sum(p.count("a") for p in parts)
    assert chunks.chunk(text, size, 5) == parts


def test_keys():
    assert [keys.close_key(x) for x in ("e-mail", "clickstreem", "telephone numbers", "shoe size", "")] == ["email", "usage data", "phone number", "shoe size", ""]


def test_cascade_of_providers():
    def broken(prompts):
        raise ValueError("down")

    ask = providers.cascade([broken, lambda p: ["", "ok"][: len(p)], lambda p: ["late"] * len(p)], bool)
    assert ask(["a", "b"]) == ["late", "ok"]
    assert providers.cascade([lambda p: ["bad"] * len(p)], lambda a: a == "good")(["a"]) == ["bad"]
    with pytest.raises(ValueError):
        providers.cascade([broken], bool)(["a"])


def test_rules_spare_the_provider(spark):
    asked = spark.sparkContext.accumulator(0)

    def provider(prompts):
        asked.add(len(prompts))
        return ["m"] * len(prompts)

    df = spark.createDataFrame([(1, "rule"), (2, "free"), (3, None)], "id long, t string")
    found = {r["id"]: r["label"] for r in providers.fill(df, "id", F.when(F.col("t") == "rule", "r"), F.col("t"), provider).collect()}
    assert found == {1: "r", 2: "m", 3: "m"} and asked.value == 2


def test_citations_of_one_quote(spark):
    rows = [("p", "d1", 'The "Licence" ends.', True, "s", 2), ("p", "d1", "the license ends", False, None, 1), ("p", "d2", "  ", True, None, 3)]
    df = spark.createDataFrame(rows, "product_id string, document_id string, quote string, verified boolean, section string, seq int")
    found = evidence.distinct_citations(df, ["product_id"]).collect()
    assert [(r["document_id"], r["quote"], r["seq"]) for r in found] == [("d1", "the license ends", 1)]
    many = spark.createDataFrame([("p", f"d{i}", f"q{i}", i % 2 == 0, None, i) for i in range(8)], df.schema)
    assert [r["document_id"] for r in evidence.best(many, ["product_id"]).orderBy("place").collect()] == ["d0", "d2", "d4", "d6", "d1"]


def test_quotes_in_texts(spark):
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "one two three"), (3, None)], "doc_id long, text string")
    asks = spark.createDataFrame([(7, "one two three four five six"), (8, "two three four five six seven")], "item_id long, quote string")
    assert [tuple(r) for r in quotes.contained(docs, asks).collect()] == [(1, 7, 2, 29)]
    df = spark.createDataFrame([("He said “it’s  fine” (ok).", 'said "it\'s fine" (ok)'), ("abc", "b"), ("abc", "z")], "t string, q string")
    found = [tuple(r["o"]) for r in df.select(quotes.offsets(F.col("t"), F.col("q")).alias("o")).collect()]
    assert found == [(3, 25, True), (1, 2, True), (None, None, False)]


def test_ai_usage_and_family_findings(spark):
    schema = "product_id string, document_id string, ai_usage array<struct<usage_type: string, description: string>>, corporate_family_sharing array<struct<entities: array<string>>>"
    df = spark.createDataFrame([("p", "d", [("training_on_user_data", "we train"), ("profiling", "")], [(["A", "B"],)])], schema)
    found = {(r["category"], r["value"], r["normalized_value"]) for r in findings.of_extractions(df).collect()}
    assert found == {("ai_training", "we train", "training_on_user_data:we train"), ("automated_decisions", "profiling", "profiling:"), ("corporate_family_sharing", "A, B", "a,b")}


def test_fields_merge_by_policy(spark):
    schema = "document_id string, key string, seq int, data_shared array<string>, purpose string, risk_level string"
    df = spark.createDataFrame([("d", "k", 2, ["b", "c"], "long purpose", "odd"), ("d", "k", 1, ["a", "b"], "short", "high"), ("d", "k", 3, [], None, "low")], schema)
    r = merge.merge_field(df, "third_party_details").collect()[0]
    assert (list(r["data_shared"]), r["purpose"], r["risk_level"]) == (["a", "b", "c"], "long purpose", "low")


def test_crawl_and_sitemaps(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    found = dict(products.crawl(links, spark.createDataFrame([("a",)], "url string"), 3, lambda df: df.checkpoint() if spark.sparkContext.getCheckpointDir() else df).collect())
    assert found == {"a": 0, "b": 1, "c": 2, "d": 3}
    children = spark.createDataFrame([("s", f"http://s/{'privacy' if i < 3 else 'blog'}-{i}.xml") for i in range(20)], "site string, url string")
    assert pages.sitemap_children(children, F.lit(1), generic=8).count() == 11
    xml = spark.createDataFrame([("<urlset><url><loc> http://a/?x=1&amp;y=2 </loc></url></urlset>",)], "x string")
    assert list(xml.select(pages.sitemap_locations(F.col("x"))).first()[0]) == ["http://a/?x=1&y=2"]


def test_log_signals(spark):
    lines = spark.createDataFrame([("w", 1, "process 120.5MB used"), ("w", 2, "process 90MB used"), ("w", 3, "killed: out of memory")], "w string, seq int, line string")
    r = logs.memory_signals(lines, "w", "seq", "line", r"process ([0-9.]+)MB").collect()[0]
    assert (r["samples"], r["most"], r["latest"], r["oom"]) == (2, 120.5, 90.0, True)


def test_validated_append_and_admission(spark):
    good, bad = products.validated(spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id int, t string"), F.length("t") > 0)
    assert [r["id"] for r in good.collect()] == [1] and sorted(r["id"] for r in bad.collect()) == [2, 3]
    urls = spark.createDataFrame([("https://a.com/x", 1), ("http://a.com/x", 1), ("https://a.com/x.png", 1), ("https://staging.a.com/", 1), ("https://b.com/", 1), ("https://a.com/", 9)], "u string, d int")
    reason = products.admit_url(F.col("u"), F.col("d"), F.array(F.lit("a.com")), F.array(F.lit("bad.com")))
    assert [r[0] for r in urls.select(reason).collect()] == [None, "scheme", "asset", "mirror", "other_domain", "too_deep"]


def test_merges_are_dealt_to_tasks_of_bounded_rows(spark):
    from vellum.operators import merge

    own = spark.range(4000).selectExpr("id % 1000 AS document_id", "id AS seq", "concat('v', id % 7) AS value", "'material' AS materiality")
    cut = merge.dealt(own, rows=100)
    assert cut.rdd.getNumPartitions() == 40 and cut.count() == 4000
    merged = merge.merge_field(merge.keyed(cut, "text_items"), "text_items").groupBy("document_id").count()
    assert merged._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and merged.count() == 1000
