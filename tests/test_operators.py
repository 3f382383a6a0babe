"""Operators on small tables: the cases that their rules turn on."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vellum.operators import ingest, jobs, merge, rollup, store, topics
from vellum.sources import pages
from vellum.sources.bindings import CATEGORIES
from vellum.streaming import events

FINDING = "product_id string, document_id string, category string, value string, normalized_value string, materiality string, evidence int, seq int"


def finding(i, category, value, document="d1", evidence=1):
    return ("p", document, category, value, " ".join(value.lower().split()), "material", evidence, i)


def test_items_keep_the_first_value_and_order(spark):
    rows = [finding(3, "security", "TLS  in transit", "d2"), finding(1, "security", "tls in transit", "d1"), finding(5, "security", "TLS in transit", "d2")]
    r = rollup.items(spark.createDataFrame(rows, FINDING)).collect()
    assert [(x["value"], list(x["document_ids"])) for x in r] == [("tls in transit", ["d1", "d2"])]
    assert [list(x["documents"]) for x in rollup.aggregated(spark.createDataFrame(rows, FINDING)).collect()] == [["d1", "d2", "d2"]]


def test_children_statements_conflict_by_meaning(spark):
    same = [finding(1, "children", "minimum age: 18"), finding(2, "children", "children_data_collection:no")]
    other = [finding(1, "children", "minimum age: 18"), finding(2, "children", "children_data_collection:yes")]
    assert rollup.conflicts(spark.createDataFrame(same, FINDING)).count() == 0
    assert rollup.conflicts(spark.createDataFrame(other, FINDING)).count() == 1


def test_coverage_has_every_category(spark):
    f = spark.createDataFrame([finding(1, "security", "x")], FINDING)
    rows = rollup.coverage(f, spark.createDataFrame([("p",), ("q",)], "product_id string"), CATEGORIES).groupBy("product_id", "status").count().collect()
    assert {(r[0], r[1]): r[2] for r in rows} == {("p", "found"): 1, ("p", "missing"): 22, ("q", "not_analyzed"): 23}


def stances(spark, evidence, signal, conflicts=()):
    f = spark.createDataFrame([finding(i, "security", f"v{i}", evidence=1) for i in range(evidence)], FINDING)
    c = spark.createDataFrame([("p", x, 2, 1) for x in conflicts], "product_id string, category string, n_values long, n_documents long")
    cover = spark.createDataFrame([("p", "security", "found"), ("p", "retention", "missing")], "product_id string, category string, status string")
    rows = topics.stances(cover, topics.counts(f, c), f.withColumn("signal", F.lit(signal)))
    return rows, {r["category"]: (r["status"], r["stance"], r["rationale_key"]) for r in rows.collect()}


def test_evidence_caps_and_conflicts_override(spark):
    assert stances(spark, 2, 9)[1]["security"] == ("found", "fair", "topic.thin_evidence")
    assert stances(spark, 3, 9)[1]["security"] == ("found", "harmful", "topic.findings_summary")
    assert stances(spark, 3, 2)[1]["security"] == ("found", "fair", "topic.positive_practice")
    rows, by = stances(spark, 3, 2, ["security"])
    assert by["security"] == ("ambiguous", "conflicting", "topic.conflicts_found") and by["retention"] == ("missing", "not_disclosed", "topic.not_disclosed")
    assert topics.product_risk(rows).collect()[0]["risk"] == 7  # silence is left out


def test_clusters_are_cleaned():
    assert rollup.clean_clusters([[1, 1, 9], ["x", 0]], 4) == [[1], [0], [2], [3]]


def test_failing_judge_leaves_items_alone(spark):
    def judge(category, values):
        raise RuntimeError

    f = spark.createDataFrame([finding(1, "security", "aa"), finding(2, "security", "b")], FINDING)
    first = f.groupBy(*rollup.KEY).agg(F.min("seq").alias("seq"))
    assert rollup.merge_clusters(rollup.cluster(rollup.items(f).join(first, rollup.KEY), judge)).count() == 2


def test_job_rules(spark):
    rows = [(1, "HTTP 403", 403), (2, "timed out", None), (3, "robots say no", None), (4, None, 503), (5, "captcha shown", 200)]
    df = spark.createDataFrame(rows, "id int, error string, status_code int")
    found = df.select("id", jobs.error_class(F.col("error"), F.col("status_code")).alias("k"), jobs.hard(F.col("error"), F.col("status_code")).alias("h"), jobs.retryable(F.lit(3), F.col("error"), F.col("status_code")).alias("r"), jobs.retryable(F.lit(12), F.col("error"), F.col("status_code")).alias("last")).orderBy("id").collect()
    assert [r["k"] for r in found] == ["http_error", "timeout", "robots", "http_error", "unknown"]
    assert [r["h"] for r in found] == [True, False, False, False, True]
    assert [r["r"] for r in found] == [False, True, False, True, False] and not any(r["last"] for r in found)


def test_empty_updates_do_not_overwrite(spark):
    old = spark.createDataFrame([(1, "text", "t"), (2, "b", "u")], "id int, markdown string, title string")
    new = spark.createDataFrame([(1, "", "new"), (3, "c", None)], "id int, markdown string, title string")
    assert {tuple(r) for r in store.guarded_update(old, new, "id", ["markdown"]).collect()} == {(1, "text", "new"), (2, "b", "u"), (3, "c", None)}


def test_changes_ignore_the_order_of_sets(spark):
    schema = "id int, title string, regions array<string>"
    old, new = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["x"])], schema), spark.createDataFrame([(1, "a", ["y", "x"]), (2, None, ["z"])], schema)
    assert [(r[0], list(r[1])) for r in store.changed_fields(old, new, "id", ["title"], ["regions"]).collect()] == [(2, ["title", "regions"])]


def test_history_skips_unchanged_states(spark):
    rows = [("p", 1, "h1", "B"), ("p", 2, "h1", "C"), ("p", 3, "h2", "D")]
    found = store.history(spark.createDataFrame(rows, "k string, ts int, state string, grade string"), "k", "ts", "state", "grade").orderBy("ts").collect()
    assert [(r["ts"], r["delta"], r["place"]) for r in found] == [(1, None, 2), (3, 1, 1)]


def test_cascade_keeps_shared_documents(spark):
    left, gone = store.cascade_delete("a", spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["b"])], "id int, owners array<string>"), "id", "owners")
    assert {(r[0], tuple(r[1])) for r in left.collect()} == {(2, ("b",)), (3, ("b",))} and [r[0] for r in gone.collect()] == [1]


def test_merges(spark):
    rows = [("k", 1, "low", "aa"), ("k", 2, "odd", "bb"), ("k", 3, "high", "c")]
    df = spark.createDataFrame(rows, "k string, seq int, level string, v string").groupBy("k")
    got = df.agg(merge.longest("v", "seq").alias("a"), merge.last_valid("level", "seq", ("low", "high")).alias("b"), merge.strongest("level", {"low": 1, "high": 2}, "seq").alias("c"), merge.sticky(F.col("level") == "odd").alias("d")).collect()[0]
    assert (got["a"], got["b"], got["c"], got["d"]) == ("aa", "high", "high", True)


def test_policy_scores(spark):
    policy = "This policy explains how we collect and process personal data, your rights and data retention period. " * 6
    df = spark.createDataFrame([(policy, "Privacy Policy"), ("privacy " * 5, "x"), ("word " * 100, "")], "t string, title string")
    high, short, plain = (r[0] for r in df.select(ingest.content_score(F.col("t"), F.col("title"))).collect())
    assert high == 10.0 and short == 0.0 and plain == 0.0
    urls = spark.createDataFrame([("https://a.com/privacy-policy",), ("https://a.com/login/privacy",), ("https://a.com/templates/x-privacy",), ("https://a.com/blog/cats",)], "u string")
    good, auth, gallery, other = (r[0] for r in urls.select(ingest.url_score(F.col("u"))).collect())
    assert good > 10 and auth == gallery == other == 0.0


def test_robots(spark):
    files = spark.createDataFrame([("s", "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: bot\nDisallow: /*.pdf")], "site string, text string")
    urls = spark.createDataFrame([("s", "/private/x"), ("s", "/private/open/y"), ("s", "/a.pdf"), ("t", "/any")], "site string, path string")
    rules = pages.robots_rules(files)
    assert {r[1]: r[2] for r in pages.robots_allowed(urls, rules, "other").collect()} == {"/private/x": False, "/private/open/y": True, "/a.pdf": True, "/any": True}
    assert {r[1]: r[2] for r in pages.robots_allowed(urls, rules, "bot").collect()} == {"/private/x": True, "/private/open/y": True, "/a.pdf": False, "/any": True}


def test_page_reader(spark):
    html = '<html lang="en"><head><title> A  b </title><meta name="Description" content="d"><link rel="canonical" href="/c"></head><body><h1>H &amp; i</h1><a href="/x">one</a><a href="/x">two</a></body></html>'
    df = spark.createDataFrame([(1, html), (2, None)], "id long, html string")
    one, two = pages.html_metadata(df, "id", "html").orderBy("id").collect()
    assert (one["title"], one["description"], one["lang"], one["canonical"], list(one["headings"])) == ("A b", "d", "en", "/c", ["H & i"])
    assert [(x["url"], x["text"]) for x in one["links"]] == [("/x", "one")] and two["title"] is None


def test_streams_equal_batches(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), i % 3, "error" if i % 4 == 0 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").withColumn("failed", (F.col("event_type") == "error").cast("int"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    live = events.stream(spark, str(tmp_path / "in"), df.schema)
    q = events.breaker(live, "user_id", "failed", 4).writeStream.format("memory").queryName("breaks").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r["user_id"]: (r["failures"], r["open"]) for r in spark.table("breaks").groupBy("user_id").agg(F.max("failures").alias("failures"), F.max("open").alias("open")).collect()}
    assert last == {r["user_id"]: (r["failures"], r["open"]) for r in events.breaker_batch(df, "user_id", "failed", 4).collect()}
    q = events.windowed(live, "ts", "event_type", late="30 days").writeStream.format("memory").queryName("wins").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("wins").groupBy("start", "event_type").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == events.windowed(df, "ts", "event_type").agg(F.sum("n")).first()[0]
    q = events.ingest(live, lambda b: b.where("event_type = 'error'"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 15


def test_short_quotes_are_found(spark):
    from vellum.operators import quotes

    texts = [(1, "we keep personal data, für 30 days"), (2, "no  data\nhere"), (3, ""), (4, None), (5, "one two three four five six seven eight")]
    asked = [(1, "personal data"), (2, "a"), (3, "für 30"), (4, " data\nhere"), (5, "two three four five six"), (6, "nowhere"), (7, None), (8, ""), (9, "two three four five six seven"), (10, "  ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = quotes.contained(docs, spark.createDataFrame(asked, "item_id long, quote string")).collect()
    expected = {(i, k, t.index(q), t.index(q) + len(q)) for i, t in texts for k, q in asked if t is not None and q is not None and q in t}
    assert sorted(map(tuple, found)) == sorted(expected)
