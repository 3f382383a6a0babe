"""Brand names: cleaning, validity, and affinity to a product's slug."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that are none, endings that name a section or a legal form, and words of descriptions.
PLACEHOLDERS = ("undefined", "null", "none", "unknown", "website", "home", "homepage", "privacy", "privacy policy", "terms", "terms of service", "terms of use", "cookie policy", "cookies", "legal", "legal notice", "tos", "about", "about us", "contact", "contact us", "help", "help center", "help centre", "support", "faq", "blog", "news", "newsroom", "documentation", "docs", "developer", "developers", "status", "login", "sign in", "dashboard", "account", "settings", "search", "menu", "navigation", "skip to content", "home page", "loading", "application card", "app", "transparency center", "transparency", "trust center", "trust centre", "community", "forum", "forums", "resources", "knowledge base", "announcements")
SECTIONS = ("help center", "help centre", "trust center", "trust centre", "transparency center", "transparency centre", "community forum", "product blog", "company blog", "tech blog", "engineering blog", "developer center", "developer centre", "knowledge base", "privacy policy", "terms of service", "terms of use", "cookie policy", "legal notice", "community guidelines", "status page", "blog", "legal", "law", "privacy", "terms", "compliance", "policy", "policies", "support", "community", "forum", "forums", "docs", "documentation", "developer", "developers", "status", "security", "newsroom", "news", "press", "media", "careers", "jobs", "about", "insights", "resources", "announcements", "engineering", "learn", "help", "center", "centre", "portal", "site", "page", "card", "web player", "player", "web")
COMPANIES = ("group", "inc", "ltd", "llc", "corp", "corporation", "company", "gmbh", "sa", "bv", "ag", "co")
DESCRIPTIVE = ("account", "console", "cloud", "view", "manage", "your", "privacy", "terms", "center", "centre", "portal", "supplemental", "report", "form", "notice", "official", "website", "online", "shop", "store", "apparel", "wear", "clothing", "men", "women", "player", "web", "news", "media", "mobile", "product", "services", "platform", "suite", "365", "data", "acceptable", "use", "management", "policy", "agreement", "at", "on", "of", "the", "a", "an", "and", "or", "cookie", "cookies")

EDGES = r"^[ \-|·:—»]+|[ \-|·:—»]+$"
BREAKS = r"\s*(?: - | – | — | \| | · | : | :: | » )\s*"
ENDING = "(?:" + "|".join(map(re.escape, (*SECTIONS, *COMPANIES))).replace(r"\ ", " ") + ")"
ENDINGS = rf"(?i)(?:[ \-|·:—»]+{ENDING})+$"
ONLY_ENDINGS = rf"(?i)^{ENDING}(?:[ \-|·:—»]+{ENDING})*$"
DATE = r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+[0-9]{4}$"


def strip(name: Column) -> Column:
    return F.regexp_replace(name, EDGES, "")


def clean(name: Column) -> Column:
    """A brand without the endings that name a section or a legal form; '' where nothing else is left."""
    out = strip(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")))
    for marks in (r"[,.]+$", r"[®™©℠]+$", r"[,.]+$"):
        out = strip(F.regexp_replace(out, marks, ""))

    def body(whole: Column) -> Column:
        parts = F.split(whole, BREAKS)
        kept = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(*SECTIONS))
        own = F.when((F.size(kept) > 0) & (F.size(kept) < F.size(parts)), strip(F.array_join(kept, " - "))).otherwise(whole)
        left = F.when(own.rlike(ONLY_ENDINGS), "").otherwise(F.regexp_replace(own, ENDINGS, ""))
        return F.regexp_replace(strip(left), r"[,.]+$", "")

    return F.transform(F.array(out), body)[0]


def valid(name: Column) -> Column:
    """Whether a name could be a brand's and is no placeholder, address, number, date or country code."""
    odd = F.lower(name).isin(*PLACEHOLDERS) | name.contains("://") | name.startswith("www.") | name.rlike(r"^[0-9.]*[0-9][0-9.]*$") | name.rlike(DATE) | name.rlike(r"^[A-Z]{2}$")
    return F.length(name).between(2, 60) & ~odd


def descriptive(name: Column) -> Column:
    words = F.split(F.lower(name), r"\s+")
    return (F.size(words) > 1) & F.exists(words, lambda w: w.isin(*DESCRIPTIVE))


def related(name: Column, slug: Column) -> Column:
    """Whether one's letters hold the other's, or those of a slug of four or more stand in the name in order."""
    token, key = (F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "") for x in (name, slug))
    spread = F.call_function("rlike", token, F.array_join(F.split(key, ""), ".*"))
    return (token != "") & (key != "") & (token.contains(key) | key.contains(token) | ((F.length(key) >= 4) & spread))


def acceptable(cleaned: Column, slug: Column) -> Column:
    return valid(cleaned) & (F.size(F.split(cleaned, r"\s+")) <= 2) & ~descriptive(cleaned) & related(cleaned, slug)
