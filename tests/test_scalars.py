"""Scalar functions, row by row."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import coerce, grades, text, url


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


CANONICAL = [
    ("https://a.com/en/privacy", "https://a.com/privacy"),
    ("https://a.com/legal/de/privacy/", "https://a.com/legal/privacy"),
    ("https://a.com/en-US/privacy", "https://a.com/en-US/privacy"),
    ("https://a.com/zh/privacy", "https://a.com/zh/privacy"),
    ("https://a.com/en", "https://a.com/"),
    ("https://a.com/p?lang=en&id=3#top", "https://a.com/p?id=3"),
    ("https://a.com/p?locale=en-US&hl=de", "https://a.com/p?locale=en-US"),
]


def test_canonicalize(spark):
    once = values(spark, url.canonicalize, [a for a, _ in CANONICAL])
    assert once == [b for _, b in CANONICAL]
    assert values(spark, url.canonicalize, once) == once


def test_normalize(spark):
    rows = ["https://a.com/p/?utm_source=x&gclid=1&id=2#f", "https://a.com/p/", "https://a.com/", "https://a.com/p?REL=1"]
    assert values(spark, url.normalize, rows) == ["https://a.com/p/?id=2", "https://a.com/p", "https://a.com/", "https://a.com/p"]


def test_domains(spark):
    assert values(spark, url.base_domain, ["https://www.shop.example.co.uk:80/x", "a.b.com", "localhost"]) == ["example.co.uk", "b.com", "localhost"]
    assert values(spark, url.domain_name, ["my-shop.com"]) == ["My Shop"]


def test_text(spark):
    assert values(spark, text.normalize_value, ["  A \t b\nC ", None]) == ["a b c", ""]
    assert values(spark, lambda x: text.truncate(x, 10), ["short", "a long sentence"]) == ["short", "a long..."]
    capped = values(spark, lambda x: text.cap(x, 30), ["y" * 50, "z"])
    assert len(capped[0]) == 30 and values(spark, lambda x: text.cap(x, 30), capped) == capped
    assert values(spark, text.garbled, ["é" * 200, "plain " * 40, "é"]) == [True, False, False]
    assert values(spark, text.markdown_to_text, ["# Title\n\n- a **b** [c](http://x)\n```\ncode\n```"]) == ["Title a b c"]
    assert values(spark, lambda x: text.contains_word(x, "dpa"), ["our DPA.", "sandpaper"]) == [True, False]


def test_grades(spark):
    assert values(spark, grades.coerce, ["a", " B+", "x", None]) == ["A", "B", "C", "C"]
    assert [r[0] for r in spark.range(11).select(grades.of_risk_score(F.col("id"))).collect()] == list("AAABBCCDDEE")
    df = spark.createDataFrame([("E", "B"), ("A", "B"), ("A", "E"), ("?", "D")], "p string, d string")
    assert [r[0] for r in df.select(grades.clamp(F.col("p"), F.col("d"))).collect()] == ["C", "A", "D", "D"]
    halves = spark.createDataFrame([(2.5,), (3.5,), (7.5,)], "x double")
    assert [r[0] for r in halves.select(grades.of_user_score(F.col("x"))).collect()] == ["D", "C", "A"]


def test_coercions(spark):
    assert values(spark, coerce.yes_no_unclear, [" Yes", "0", "NULL", "maybe", None]) == ["yes", "no", "unclear", None, "unclear"]
    assert values(spark, coerce.boolean, ["TRUE", "off", "?"]) == [True, False, None]


@pytest.mark.parametrize("raw,found", [("2024-03-05", "2024-03-05"), ("MARCH 5, 2024", "2024-03-05"), ("5 mar 2024", "2024-03-05"), ("2021", "2021-01-01"), ("1999-01-01", None), ("soon", None)])
def test_dates(spark, raw, found):
    assert str(values(spark, coerce.parse_date, [raw])[0]) == str(found)
