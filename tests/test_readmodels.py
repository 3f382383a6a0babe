"""Row-level cases of materiality, guards, merges and read models."""

from pyspark.sql import functions as F

from vellum.functions import text
from vellum.operators import findings, materiality, merge, readmodels, rollup, store


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_tiers_default_to_material(spark):
    df = rows(spark, [("term", None), ("term", "odd"), ("", None), (" ", "notable"), ("x", " Standard_Industry ")], "t string, l string")
    assert [r[0] for r in df.select(materiality.tier(F.col("t"), F.col("l"))).collect()] == ["material_risk", "material_risk", "standard_industry", "notable", "standard_industry"]


def test_watch_out_cases(spark):
    df = rows(spark, [("a", "notable", "critical", "Blocker"), ("b", "notable", "odd", ""), ("c", "standard_industry", "high", "x"), ("d", None, "high", "x"), ("e", "notable", "low", None)], "text string, label string, severity string, classification string")
    found = [(r["text"], r["severity"], r["classification"]) for r in materiality.watch_out(df).collect()]
    assert found == [("a", "medium", "informational"), ("b", "medium", "informational"), ("d", "high", "x"), ("e", "low", "informational")]


def test_signals_by_category(spark):
    data = [("data_sale", "sells_data: yes", None, 1, 9), ("data_sale", "sells_data: no", None, 1, 2), ("breach_notification", "breach_notification: no", None, 1, 7), ("security", "x", None, 2, 3), ("dangers", "x", "notable", 1, None), ("dangers", "x", None, 1, 8), ("benefits", "x", None, 1, 3), ("consent_mechanisms", "x", None, 1, 5)]
    df = rows(spark, data, "c string, v string, l string, d int, want int")
    none = F.lit(None).cast("string")
    got = df.select("want", materiality.topic_signal(F.col("c"), F.col("v"), F.col("l"), F.col("d"), none, none, none, F.lit(False), none, F.lit(False)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_guards_on_silence_and_empty_lists(spark):
    schema = "headline string, summary string, grade string, justification string, adequate boolean, rights array<string>, dangers array<string>, benefits array<string>, actions array<string>, stances array<struct<status: string, evidence_count: int>>"
    silent = [("missing", 0), ("not_disclosed", None), ("missing", 0), ("found", 0)]
    data = [(" ", "s", "e", None, True, [], [], [], [], silent), ("h", "s", None, None, True, ["You may ask them"], ["d"] * 5, ["b"], ["Think"], []), ("h", "s", "E", "j", False, ["Contact them", "email the company"], [], [], ["Opt out"], [("missing", 1)])]
    a, b, c = materiality.overview_guards(rows(spark, data, schema), text.word_count, text.long_sentences).collect()
    assert (a["headline_not_empty"], a["no_e_grade_on_silence"], a["re_roll"], a["rights_have_paths"], a["actions_actionable"]) == (False, False, True, True, True)
    assert (b["re_roll"], b["rights_have_paths"], b["dangers_benefits_balance"], b["actions_actionable"]) == (False, False, False, False)
    assert c["rights_have_paths"] and c["no_e_grade_on_silence"] and c["actions_actionable"]


def test_merge_keys_know_their_kinds(spark):
    df = rows(spark, [(1, "CAP ", "Fees", "first", False, 1), (1, "cap", " fees", "a longer second one", True, 2), (1, "odd", "Fees", "x", False, 3)], "document_id int, limitation_type string, scope string, description string, extends_beyond_product boolean, seq int")
    found = {r["key"]: (r["description"], r["extends_beyond_product"]) for r in merge.merge_field(merge.keyed(df, "liability"), "liability").collect()}
    assert found == {"cap:fees": ("first", True), "waiver:fees": ("x", False)}


def test_children_and_blank_items(spark):
    df = rows(spark, [(1, 1, (13, True, "None sold")), (1, 2, (None, False, "")), (1, 3, None)], "product_id int, document_id int, children_policy struct<minimum_age: int, parental_consent_required: boolean, special_protections: string>")
    assert [(r["document_id"], r["value"]) for r in findings.of_children(df).collect()] == [(1, "Minimum age: 13; Parental consent required; None sold")]
    odd = rows(spark, [(1, 1, [("", "d"), ("arbitration", ""), ("Court", "Only in court")])], "product_id int, document_id int, dispute_resolution array<struct<mechanism: string, description: string>>")
    found = [(r["value"], r["normalized_value"], r["materiality"]) for r in findings.of_field(odd, "dispute_resolution").collect()]
    assert found == [("arbitration", "arbitration", "notable"), ("Only in court", "court", "notable")]


def test_keypoints_take_three_spans(spark):
    points = rows(spark, [(1, "They share EMAIL and location"), (2, "none")], "document_id int, keypoint string")
    evidence = rows(spark, [(1, "email", i) for i in range(5)] + [(1, " ", 9), (2, "email", 1)], "document_id int, value string, seq int")
    assert [(r["document_id"], r["seq"]) for r in rollup.keypoint_evidence(points, evidence).orderBy("seq").collect()] == [(1, 0), (1, 1), (1, 2)]


def test_breaker_lets_one_probe_through(spark):
    times = [(1, "k", 0.0, True), (2, "k", 1.0, True), (3, "k", 2.0, False), (4, "k", 70.0, True), (5, "k", 80.0, False), (6, "k", 140.0, False), (7, "k", 141.0, True)]
    out = readmodels.breaker(rows(spark, times, "id int, key string, at double, failed boolean"), "key", "at", "failed", "id", threshold=2, reset=60.0)
    assert [(r["allowed"], r["state"]) for r in out.orderBy("id").collect()] == [(True, "closed"), (True, "closed"), (False, "open"), (True, "half_open"), (False, "open"), (True, "half_open"), (True, "closed")]


def test_titles_and_upserts(spark):
    df = rows(spark, [(" A  b ", "# H", "http://x.org/p"), (None, "t\n# The  head\n", "http://x.org/p"), (None, None, "http://www.shop.org/"), ("", "", "http://x.org/a/cookie-policy")], "d string, m string, u string")
    found = [tuple(r[0]) for r in df.select(readmodels.title(F.col("d"), F.col("m"), F.col("u"), F.lit("cookie_policy"))).collect()]
    assert found == [("A b", "metadata"), ("The head", "markdown_header"), ("Shop — Cookie Policy", "url_fallback"), ("Cookie Policy — Cookie Policy", "url_fallback")]
    df = rows(spark, [("a", "a"), ("a", ""), ("a", None), ("a", "b"), (None, "b")], "o string, n string")
    assert [r[0] for r in df.select(store.upsert_action(F.col("o"), F.col("n"), F.lit("m"))).collect()] == ["skip", "skip", "skip", "update", "update"]


def test_browser_fallback(spark):
    long = "<html><script>" + "x" * 900 + "</script><p>" + "word " * 200 + "</p></html>"
    data = [(429, "text/html", ""), (404, "text/html", long), (200, "application/pdf", long), (200, "text/html", "short"), (200, "text/html; charset=x", long), (200, "text/html", "<script>" + "x" * 900 + "</script>"), (503, "text/plain", "y" * 600)]
    got = rows(spark, data, "s int, k string, b string").select(readmodels.needs_browser(F.col("s"), F.col("k"), F.col("b"))).collect()
    assert [r[0] for r in got] == [False, True, True, True, False, True, False]
