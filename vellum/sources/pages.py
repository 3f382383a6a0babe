"""Page sources: HTML metadata and links, Markdown, plain text, sitemaps and robots rules."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Pages of about so many characters are read before their rows go on.
READ_CHARS = 1 << 20
HTML_SCHEMA = "title string, description string, lang string, canonical string, headings array<string>, links array<struct<url: string, text: string>>"


class _Reader(HTMLParser):
    """Collects a page's title, metadata, headings and links."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.headings: list[str] = []
        self.links: list[dict] = []
        self.lang = self.canonical = self.title = None
        self.into: list[str] | None = None
        self.link: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = self.lang or a.get("lang")
        elif tag == "meta" and (name := a.get("name") or a.get("property")):
            self.meta.setdefault(name.lower(), a.get("content") or "")
        elif tag == "link" and (a.get("rel") or "").lower() == "canonical":
            self.canonical = self.canonical or a.get("href")
        elif tag == "title" or re.fullmatch("h[1-6]", tag):
            self.into = []
        elif tag == "a" and a.get("href"):
            self.link = (a["href"], [])

    def handle_endtag(self, tag):
        if self.into is not None and (tag == "title" or re.fullmatch("h[1-6]", tag)):
            words = " ".join("".join(self.into).split())
            if tag == "title":
                self.title = self.title or words
            else:
                self.headings.append(words)
            self.into = None
        elif tag == "a" and self.link:
            self.links.append({"url": self.link[0], "text": " ".join("".join(self.link[1]).split())})
            self.link = None

    def handle_data(self, data):
        if self.into is not None:
            self.into.append(data)
        if self.link:
            self.link[1].append(data)


def read_page(page: str | None) -> dict:
    reader = _Reader()
    if page:
        try:
            reader.feed(page)
            reader.close()
        except (AssertionError, ValueError):
            pass  # what was read before a broken declaration stays
    seen = {x["url"]: x for x in reversed(reader.links)}
    first = [x for x in reader.links if seen.get(x["url"]) is x]
    return {"title": reader.title, "description": reader.meta.get("description"), "lang": reader.lang, "canonical": reader.canonical, "headings": reader.headings, "links": first}


def html_metadata(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, description, lang, canonical, headings, links): what a page's markup says; links once, the first of each."""

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for i, page in zip(batch.column(0), batch.column(1)):
                held.append({"id": i.as_py(), **read_page(page.as_py())})
                size += len(page.as_py() or "")
                if size > READ_CHARS:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    kind = pages.schema[id_col].dataType.simpleString()
    own = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    schema = to_arrow_schema(StructType.fromDDL(f"id {kind}, {HTML_SCHEMA}"))
    return own.mapInArrow(run, f"id {kind}, {HTML_SCHEMA}").withColumnRenamed("id", id_col)


def markdown_title(text: Column) -> Column:
    """The first heading outside fences."""
    plain = F.regexp_replace(text, r"(?s)```.*?```", "")
    return F.nullif(F.trim(F.regexp_extract(plain, r"(?m)^#\s+(.+)$", 1)), F.lit(""))


def markdown_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)"), F.lit(1))


def plain_title(text: Column, keywords: tuple[str, ...] = ("privacy", "terms", "policy")) -> Column:
    """The first of the first five lines that has a keyword or is short."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 5), lambda x: F.trim(x)), lambda x: x != "")
    return F.get(F.filter(lines, lambda x: F.lower(x).rlike("|".join(keywords)) | (F.length(x) < 100)), F.lit(0))


def sitemap_locations(xml: Column) -> Column:
    """URLs of a sitemap or sitemap index."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def sitemap_children(children: DataFrame, score: Column, policy: str = "legal|privacy|terms|policy|tos|gdpr|ccpa|dpa|cookie|compliance|trust", most: int = 200, generic: int = 8) -> DataFrame:
    """Child sitemaps to follow: policy-named ones first, both kinds capped, by score."""
    named = F.col("url").rlike(f"(?i){policy}")
    ranked = children.withColumn("named", named).withColumn("place", F.row_number().over(W.partitionBy("site", "named").orderBy(F.desc(score), "url")))
    return ranked.where(F.col("place") <= F.when(F.col("named"), most).otherwise(generic))


def robots_rules(files: DataFrame) -> DataFrame:
    """(site, agent, seq, kind, pattern) of robots texts (site, text): each rule under the agents above it."""
    lines = files.select("site", F.posexplode(F.split("text", "\r?\n")).alias("seq", "line"))
    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    name, value = F.lower(F.trim(F.regexp_extract("line", "^([^:]*):", 1))), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    pairs = clean.select("site", "seq", name.alias("name"), value.alias("value"))
    order = W.partitionBy("site").orderBy("seq")
    agent = F.last(F.when(F.col("name") == "user-agent", F.lower("value")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return pairs.withColumn("agent", agent).where("name in ('allow', 'disallow') and value <> '' and agent is not null").select("site", "agent", "seq", F.col("name").alias("kind"), F.col("value").alias("pattern"))


def robots_regex(pattern: str) -> str:
    body = re.escape(pattern.rstrip("$")).replace(r"\*", ".*")
    return "^" + body + ("$" if pattern.endswith("$") else "")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """(site, path, allowed): an allow rule that fits wins, then a disallow rule; rules of the agent, else of '*'."""
    own = rules.where(F.col("agent") == agent)
    mine = own.unionByName(rules.where("agent = '*'").join(own.select("site").distinct(), "site", "left_anti"))
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("pattern", r"([.+?()\[\]{}|^\\])", r"\\$1"), r"\*", ".*"))
    lists = mine.groupBy("site").agg(F.collect_set(F.struct("kind", pattern.alias("regex"))).alias("rules"))  # as long as a robots text
    fits = lambda kind: F.exists("rules", lambda r: (r["kind"] == kind) & F.rlike(F.col("path"), r["regex"]))
    allowed = F.coalesce(fits("allow"), F.lit(False)) | ~F.coalesce(fits("disallow"), F.lit(False))
    return urls.join(lists, "site", "left").select("site", "path", allowed.alias("allowed"))


