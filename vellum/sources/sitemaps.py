"""Sitemap files as bytes, and the URLs that a site's tree of sitemaps holds, one level deep."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.ingest import url_score

from .pages import sitemap_children

# Where a site's sitemap may lie, and the largest file that is read.
WELL_KNOWN = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml")
MOST_BYTES = 5_000_000
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def inflate(raw: bytes, most: int = MOST_BYTES) -> bytes | None:
    """A gzip file's content; null if it is damaged or larger than most."""
    machine = zlib.decompressobj(wbits=31)
    try:
        out = machine.decompress(raw, most + 1)
    except zlib.error:
        return None
    return out if machine.eof and len(out) <= most else None


def body(url: Column, raw: Column) -> Column:
    """The text of a file, unpacked where its first bytes or its name say gzip; null for damaged or too large files.

    Bytes that are no UTF-8 become replacement marks.
    """

    @F.arrow_udf("string")
    def decoded(files: pa.Array, packed: pa.Array) -> pa.Array:
        raw = [inflate(r) if r is not None and p else r for r, p in zip(files.to_pylist(), packed.to_pylist())]
        return pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())

    packed = (F.hex(F.substring(raw, 1, 2)) == "1F8B") | F.lower(url).endswith(".gz")
    return decoded(F.when(F.octet_length(raw) <= MOST_BYTES, raw), packed)


def is_sitemap(text: Column) -> Column:
    """Whether a file looks like a sitemap: no page of HTML, and a sitemap's root or an XML head."""
    start = F.ltrim(F.regexp_replace(F.substring(text, 1, 8192), r"^\s+", ""))
    page = F.lower(F.substring(start, 1, 512)).rlike("^(?:<!doctype html|<html)")
    return ~page & (F.substring(start, 1, 4096).rlike(r"(?i)<(?:urlset|sitemapindex)\b") | start.startswith("<?xml"))


def locations(text: Column) -> Column:
    """The first location of each sitemap of an index, else of each URL."""

    def of(tag: str) -> Column:
        blocks = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
        found = F.transform(blocks, lambda b: F.regexp_replace(F.regexp_extract(b, r"(?s)<loc(?:\s[^>]*)?>\s*(.*?)\s*</loc>", 1), r"^<!\[CDATA\[\s*(.*?)\s*\]\]>$", "$1"))
        return F.filter(found, lambda x: x != "")

    def clean(x: Column) -> Column:
        for name, sign in ENTITIES.items():
            x = F.replace(x, F.lit(name), F.lit(sign))
        return x

    return F.transform(F.when(text.rlike(r"<sitemap[\s>]"), of("sitemap")).otherwise(of("url")), clean)


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(site, seq, url) of the Sitemap lines of robots texts (site, text)."""
    lines = robots.select("site", F.posexplode(F.split("text", "\r?\n")).alias("seq", "line"))
    return lines.select("site", "seq", F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*([^\s#]+)", 1)).alias("url")).where("url <> ''")


def candidates(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """(site, seq, url): what robots texts name, then the well-known places that they do not name."""
    named = robots_sitemaps(robots)
    known = sites.select("site", F.posexplode(F.transform(F.array(*map(F.lit, WELL_KNOWN)), lambda p: F.concat("origin", p))).alias("place", "url"))
    bare = F.regexp_replace("url", "/+$", "")
    told = named.select("site", bare.alias("bare")).distinct()
    rest = known.withColumn("bare", bare).join(told, ["site", "bare"], "left_anti").select("site", (F.col("place") + 1_000_000).alias("seq"), "url")
    return named.unionByName(rest)


def discover(sites: DataFrame, robots: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, damaged): pages (site, url, depth, sitemap) that sites (site, origin) list in files (url, body), each once.

    Sitemaps named in an index are followed one level, those named like policies first, in the order of their score
    and then of the index; a page keeps the sitemap that names it first. damaged: (site, url) of files that exist but are no
    sitemaps, cannot be unpacked, are too large or end too early; of the last, what is whole counts.
    """
    read = files.select("url", body(F.col("url"), F.col("body")).alias("text"))
    closed = F.coalesce(F.col("text").rlike("(?i)</(?:urlset|sitemapindex)>"), F.lit(False)).alias("closed")
    read = read.select("url", closed, F.when(is_sitemap(F.col("text")), locations(F.col("text"))).alias("found"))

    def opened(wanted: DataFrame) -> DataFrame:
        return wanted.join(read, "url")

    top = opened(candidates(sites, robots))
    entries = top.where("found is not null").select("site", "seq", F.col("url").alias("sitemap"), F.posexplode("found").alias("place", "url"))
    low = F.lower("url")
    child = low.contains("sitemap") & (low.endswith(".xml") | low.endswith(".xml.gz"))
    direct = entries.where(~child).select("site", "url", F.struct("seq", F.lit(0).alias("depth"), F.lit(0.0).alias("score"), F.lit(0.0).alias("worth"), "place", F.lit(0).alias("inner")).alias("order"), "sitemap")
    asked = entries.where(child).groupBy("site", "seq", "url").agg(F.min("place").alias("listed")).withColumn("worth", url_score(F.col("url")))
    follow = sitemap_children(asked.withColumn("parent", F.concat_ws("\n", "site", "seq")).withColumnRenamed("site", "owner").withColumnRenamed("parent", "site"), F.col("worth"))
    follow = opened(follow.select(F.col("owner").alias("site"), "seq", "url", "named", "worth", "listed"))
    inner = follow.where("found is not null").select("site", "seq", "named", "worth", "listed", F.col("url").alias("sitemap"), F.posexplode("found").alias("inner", "url"))
    nested = inner.select("site", "url", F.struct("seq", F.lit(1).alias("depth"), F.when(F.col("named"), 0.0).otherwise(1.0).alias("score"), (-F.col("worth")).alias("worth"), F.col("listed").alias("place"), "inner").alias("order"), "sitemap")
    first = direct.unionByName(nested).groupBy("site", "url").agg(F.min_by(F.struct(F.col("order.depth").alias("depth"), "sitemap"), "order").alias("f"))
    bad = "found is null or not closed"
    damaged = top.where(bad).select("site", "url").unionByName(follow.where(bad).select("site", "url")).distinct()
    return first.select("site", "url", "f.depth", "f.sitemap"), damaged
