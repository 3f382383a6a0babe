"""Admission of fetched pages: scores, reasons to skip, and removal of repeated content."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import policies, text, url
from vellum.functions import vocabulary as v
from vellum.operators import automaton

SHORTEST, LEAST_SCORE = 300, 0.2


def total(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def let(value: Column, use) -> Column:
    """use(value), where value is computed once."""
    return F.transform(F.array(value), use)[0]


def occurrences(low: Column, words: tuple[str, ...]) -> tuple[Column, Column]:
    """(different words that occur, letters of all occurrences) of a list of words anywhere in a text, in one pass."""
    found = automaton.scan(low, {"": tuple(words)})
    count = lambda h: F.struct(F.size(h).alias("found"), F.aggregate(h, F.lit(0), lambda n, x: n + x["n"] * F.length(x["word"])).alias("letters"))
    both = let(found, count)
    return both["found"], both["letters"]


def content_score(content: Column, title: Column, indicators=v.LEGAL_INDICATORS, phrases=v.LEGAL_PHRASES, quick: str = v.QUICK_CHECK, title_words=v.TITLE_KEYWORDS) -> Column:
    """Score from 0 to 10 of a text's policy words, weighed by their density, and of its title.

    Words are looked up only in texts that are long enough and pass the quick pattern.
    """
    enough = (F.size(F.split(F.trim(content), r"\s+")) >= 50) & (F.length(content) >= SHORTEST) & F.lower(content).rlike(quick)
    words, letters = occurrences(F.when(enough, F.lower(content)), tuple(indicators))

    def score(x: Column) -> Column:
        said = F.flatten(F.array(*[F.regexp_extract_all(x["low"], F.lit(p), F.lit(0)) for p in phrases]))
        return let(said, lambda h: (x["words"] + 2.0 * F.size(h)) * (x["letters"] + F.length(F.array_join(h, ""))))

    bonus = total([F.when(F.lower(F.coalesce(title, F.lit(""))).contains(w), 3.0).otherwise(0.0) for w in title_words])
    return F.when(enough, F.least(F.lit(10.0), let(F.struct(F.lower(content).alias("low"), words.alias("words"), letters.alias("letters")), score) / F.length(content) * 100 + bonus)).otherwise(0.0)


def url_score(address: Column, phrases=v.URL_PHRASES, keywords=v.URL_KEYWORDS, paths=policies.PATH_WEIGHTS, anchor: Column | None = None) -> Column:
    """How much a URL, and the text of a link to it, look like a policy's.

    Phrases in path and query (2.5 times in the link's text), parts of the path, each whole word of path, query and
    fragment (twice in the link's text), and words of positive weight inside others at 0.8. Single terms of a glossary
    lose; logins and galleries have 0; parameters that redirect are not read.
    """
    way = F.lower(url.path(address))
    split = F.filter(F.split(F.lower(url.query(address)), "&"), lambda x: ~F.substring_index(x, "=", 1).isin(*policies.REDIRECT_PARAMETERS))
    query = F.array_join(F.transform(split, lambda x: F.regexp_replace(F.try_url_decode(x), "=", " ")), " ")
    where = F.trim(F.concat_ws(" ", way, query))
    fragment = F.lower(F.regexp_extract(address, "#(.*)$", 1))
    tokens = lambda c: F.filter(F.split(F.regexp_replace(c, r"[^\w]+|_", " "), " "), lambda x: x != "")
    weight = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    known, known_path = weight({k: float(x) for k, x in keywords.items()}), weight(paths)
    add = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda s, x: s + value(x))
    by_phrase = total([F.when(where.rlike(p), w).otherwise(0.0) for p, w in phrases.items()])
    by_path = add(automaton.scan(way, {"": tuple(paths)}), lambda h: known_path[h["word"]]) + F.when(way.rlike(policies.HEX_PATH), policies.HEX_WEIGHT).otherwise(0.0)
    words = tokens(F.concat_ws(" ", way, query, fragment))
    by_word = add(words, lambda w: F.coalesce(F.try_element_at(known, w), F.lit(0.0)))
    inside = automaton.scan(F.concat_ws(" ", way, F.array_join(words, " ")), {"": tuple(k for k, x in keywords.items() if x > 0)})
    by_part = add(F.filter(inside, lambda h: ~F.array_contains(words, h["word"])), lambda h: 0.8 * known[h["word"]])
    parts = [by_phrase, by_path, by_word, by_part, F.when(way.rlike(policies.GLOSSARY_PATH), -policies.GLOSSARY_WEIGHT).otherwise(0.0)]
    if anchor is not None:
        said = F.lower(F.coalesce(anchor, F.lit("")))
        parts += [2.5 * total([F.when(said.rlike(p), w).otherwise(0.0) for p, w in phrases.items()])]
        parts += [2.0 * add(F.filter(F.split(said, r"\W+"), lambda x: x != ""), lambda w: F.coalesce(F.try_element_at(known, w), F.lit(0.0)))]
    return F.when(way.rlike(v.AUTH_PATH) | way.rlike(v.GALLERY_PATH), 0.0).otherwise(F.greatest(F.lit(0.0), total(parts)))


def skip_reason(content: Column, score: Column, trusted: Column, lang: Column, keep: str = "en", policy: Column | None = None) -> Column:
    """Why a page is not admitted, by the first rule that holds; null for admitted pages. policy: false if it is none."""
    reason = (
        F.when(F.length(F.coalesce(content, F.lit(""))) < SHORTEST, "too_short")
        .when(text.garbled(content), "garbled")
        .when((score / 10 < LEAST_SCORE) & ~trusted, "low_legal_score")
        .when(~lang.startswith(keep), "locale")
    )
    return reason if policy is None else reason.when(~policy, "not_policy")


def first_per_content(pages: DataFrame, owner: str, address: str, content: str, seq: str) -> DataFrame:
    """Of an owner's pages with one content fingerprint, that with the most canonical URL."""
    rank = url.canonical_rank(F.col(address))
    best = F.min_by(seq, F.struct(rank.alias("r"), F.col(seq)))
    return pages.groupBy(owner, text.fingerprint(F.col(content)).alias("fp")).agg(best.alias(seq), F.count("*").alias("n"))


def variants(pages: DataFrame, address: str, seq: str, most: int = 2) -> DataFrame:
    """At most so many language variants of each canonical URL, English ones first."""
    key = url.locale_key(F.col(address))
    order = W.partitionBy("canonical").orderBy(F.desc("is_english"), seq)
    return pages.select("*", key.canonical.alias("canonical"), key.is_english.alias("is_english")).withColumn("variant", F.row_number().over(order)).where(F.col("variant") <= most)
