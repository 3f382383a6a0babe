"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """White space runs become one space; none at either end."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_value(text: Column) -> Column:
    """The key under which values count as the same: collapsed, lower case, '' for null."""
    return F.lower(collapse(F.coalesce(text, F.lit(""))))


def fingerprint(text: Column, size: int = 5000) -> Column:
    """MD5 of the first characters of the lower-case text with collapsed white space."""
    return F.md5(F.substring(collapse(F.lower(text)), 1, size))


def document_hash(markdown: Column, doc_type: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(markdown, F.lit("")), F.coalesce(doc_type, F.lit(""))), 256)


def token_estimate(text: Column, per_token: int = 4) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / per_token)).cast("long")


def markdown_to_text(markdown: Column) -> Column:
    """Headings, emphasis, links, images, code marks and list marks go, their words stay."""
    out = F.regexp_replace(markdown, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", "")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^#{1,6}\s+", "")
    out = F.regexp_replace(out, r"[*_`~]+", "")
    out = F.regexp_replace(out, r"(?m)^\s*[-+>]\s+", "")
    return collapse(out)


def garbled(text: Column, sample: int = 1024) -> Column:
    """Whether the beginning of a text of 100 or more characters is over 8% unprintable or over 25% non-ASCII."""
    head = F.substring(text, 1, sample)
    n = F.length(head)
    control = F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    foreign = F.regexp_count(head, F.lit(r"[^\x00-\x7F]"))
    return F.coalesce((n >= 100) & ((control / n > 0.08) | (foreign / n > 0.25)), F.lit(False))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\w+")).cast("long")


def long_sentences(text: Column, words: int = 35) -> Column:
    """Sentences (between . ! ?) of more than so many words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?]+"), lambda s: F.regexp_count(s, F.lit(r"\w+")) > words)).cast("long")


def truncate(text: Column, size: int = 220) -> Column:
    cut = F.concat(F.rtrim(F.substring(text, 1, size - 3)), F.lit("..."))
    return F.when(F.length(text) > size, cut).otherwise(text)


def cap(text: Column, size: int = 150_000, suffix: str = "\n\n[truncated]") -> Column:
    """Cuts a text to size characters, the suffix included; applying it again changes nothing."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - len(suffix)), F.lit(suffix))).otherwise(text)


def contains_word(text: Column, word: str) -> Column:
    """Case-insensitive whole-word match."""
    import re

    return text.rlike(r"(?i)\b" + re.escape(word) + r"\b")


def ordered_union(*arrays: Column) -> Column:
    """Trimmed non-empty values of all arrays, first seen first."""
    parts = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))
