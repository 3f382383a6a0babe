"""The automaton against plain searches, and the cascades that read its hits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import policies
from vellum.operators import automaton, classify, ingest


def plain(text, lists):
    out = []
    for name, words in lists:
        for w in dict.fromkeys(words):
            if w in text:
                places = [i for i in range(len(text)) if text.startswith(w, i)]
                whole = sum(not (i and (text[i - 1].isalnum() or text[i - 1] == "_")) and not (i + len(w) < len(text) and (text[i + len(w)].isalnum() or text[i + len(w)] == "_")) for i in places)
                out.append((name, w, text.count(w), whole, text.index(w)))
    return out


def test_hits_match_plain_searches():
    rng = random.Random(2)
    lists = (("a", ("ab", "abab", "b", "ab", "c d")), ("b", ("abab", "é", "ba", "_a")))
    for _ in range(500):
        text = "".join(rng.choices("abcdé _.", k=rng.randint(0, 60)))
        assert automaton.hits(text, lists) == plain(text, lists)


def test_scan_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 300_000 + "ab"), (4, "none"), (5, "ab ab")], "id long, t string")
    found = {r["id"]: [tuple(h) for h in r["h"]] for r in df.select("id", automaton.scan(F.col("t"), {"l": ("ab", "", "ab")}).alias("h")).collect()}
    assert found == {1: [], 2: [], 3: [("l", "ab", 1, 0, 300_000)], 4: [], 5: [("l", "ab", 2, 2, 0)]}
    assert df.limit(0).select(automaton.scan(F.col("t"), {"l": ("ab",)})).count() == 0
    assert [r[0] for r in df.select(automaton.scan(F.col("t"), {})).collect()] == [[]] * 5


def test_every_list_is_whole():
    assert len(policies.FRAMEWORKS) == 28 and len(policies.region_words()) == 28 + sum(map(len, policies.REGION_PHRASES.values())) + 2 * len(policies.COUNTRIES)
    assert len(policies.JURISDICTIONS) == 4 and len(policies.PATH_WEIGHTS) + 1 == 56 and len(policies.LOCALE_PATHS) == 12 and len(policies.URL_HEADS) == 9


BODY = "effective date. " + "words that say little of it " * 40
CASES = [  # url, text, title, score; type, policy, stage
    ("https://h/privacy", "Last updated today.", "", 0.0, "privacy_policy", True, "url"),
    ("https://h/privacy", "nothing here", "", 0.0, "other", False, "short"),
    ("https://h/x", "y" * 400, "Privacy policy", 0.9, None, None, "undecided"),
    ("https://h/policy-hub", "y" * 400, "Privacy policy", 0.0, "privacy_policy", True, "about"),
    ("https://h/policy-hub", "y" * 400, "Photos and grandpa", 0.0, None, None, "undecided"),
    ("https://h/x", "y" * 2500, "our dpa", 0.5, "data_processing_agreement", True, "about"),
    ("https://h/x", "y" * 2500, "our dpa", None, None, None, "undecided"),
    ("https://h/x", BODY + "cookies we use, web beacons, pixel tags", "", 0.0, "cookie_policy", True, "words"),
    ("https://h/x", "z" * 1990 + "cookies we use, web beacons, pixel tags effective", "", 0.0, None, None, "undecided"),
    ("https://h/x", "menu " * 60, "", 0.0, "other", False, "menu"),
    ("https://h/x", None, None, None, "other", False, "short"),
]


def test_document_types(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "i int, url string, text string, title string, score double").withColumn("description", F.lit(None).cast("string"))
    kind = classify.document_type(F.col("signs"), F.col("text"), F.col("url"), F.col("score"))
    found = [tuple(r["t"]) for r in classify.with_signs(df).select("i", kind.alias("t")).orderBy("i").collect()]
    assert found == [c[4:] for c in CASES]


@pytest.mark.parametrize(
    "url,text,title,regions,confidence",
    [
        ("https://h/eu/jp/x", "ccpa", "", ["EU", "Asia"], 0.80),
        ("https://h/x", "ccpa", "Museum", ["EU"], 0.75),  # eu within a word, as the rule has it
        ("https://h/x", "the PIPEDA and for users in germany", "", ["Canada", "EU"], 0.85),
        ("https://h/x", "subject to the jurisdiction of\nengland", "", ["global"], 0.70),
        ("https://h/x", "governed by the laws of Peru. jurisdiction of wales", "", ["UK", "US", "Canada"], 0.85),
        ("https://h/x", "q" * 3000 + "gdpr", "", ["global"], 0.70),
        ("https://h/x", "popia_south_africa", "", ["global"], 0.70),
    ],
)
def test_regions(spark, url, text, title, regions, confidence):
    df = classify.with_signs(spark.createDataFrame([(url, text, title, "")], "url string, text string, title string, description string"))
    r = df.select(classify.document_regions(F.col("signs"), F.col("text")).alias("r")).first()["r"]
    assert (r["regions"], r["confidence"]) == (regions, confidence)


def test_url_scores(spark):
    rows = [("https://h/tos", None, 10.0), ("https://h/about#terms", None, 4.0), ("https://h/x?next=/privacy-policy", None, 0.0), ("https://h/x", "Privacy Policy", 2.5 * 8 + 2 * (5 + 4)), ("https://h/glossary/terms/word", None, 4.5 + 4.0 - 8.5), ("https://h/login/privacy", None, 0.0), ("https://h/myprivacyhub", None, 4.0)]
    df = spark.createDataFrame(rows, "u string, a string, s double")
    for r in df.select("u", "s", ingest.url_score(F.col("u"), anchor=F.col("a")).alias("got")).collect():
        want = r["s"] if r["u"] != "https://h/tos" else 5.0  # tos has a path weight alone
        assert abs(r["got"] - want) < 1e-9, (r["u"], r["got"])


def test_scores_fold_words_once():
    assert not re.search("ering|auber", "".join(__import__("vellum.functions.vocabulary", fromlist=["x"]).LEGAL_INDICATORS))
