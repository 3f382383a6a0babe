"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import url
from vellum.sources import pages as op
from vellum.sources import sitemaps
from vellum.sources.tables import read

from .registry import Registry
from .storage import HOST

register = Registry()
QUERIES, ORACLE_SQL = register.queries, register.oracles


def metadata(spark, sf_dir):
    return op.html_metadata(read(spark, sf_dir, "pages"), "page_id", "html")


HREFS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


@register(f"SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, CAST(len(list_distinct({HREFS})) AS BIGINT) AS n_links FROM pages")
def src10_html_metadata(spark, sf_dir):
    """Language and number of different links of every page, by the HTML reader."""
    return src10_html_metadata_all(spark, sf_dir)


@register()
def src10_html_metadata_all(spark, sf_dir):
    """Language and number of different links of every page."""
    return metadata(spark, sf_dir).select("page_id", "lang", F.size("links").cast("long").alias("n_links"))


@register(f"SELECT replace(link, '&amp;', '&') AS url, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest({HREFS}) AS link FROM pages) GROUP BY 1")
def ded9_link_table(spark, sf_dir):
    return ded9_link_table_all(spark, sf_dir)


@register()
def ded9_link_table_all(spark, sf_dir):
    """Pages of every link, those of several parameters too."""
    edges = metadata(spark, sf_dir).select("page_id", F.explode("links.url").alias("url"))
    return edges.groupBy("url").agg(F.countDistinct("page_id").alias("n_pages"))


@register("SELECT doc_id, (list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: trim(x, ' ')), lambda x: x <> '' AND (regexp_matches(lower(x), 'privacy|terms|policy') OR length(x) < 100)))[1] AS title FROM documents")
def src12_plain_title(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", op.plain_title(F.col("text")).alias("title"))


@register(f"SELECT host, 'sitemap' AS kind, count(*) AS n FROM (SELECT lower({HOST}) AS host, url FROM pages) GROUP BY host")
def src13_sitemap_locations(spark, sf_dir):
    """Each site's pages written as a sitemap and read back."""
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = read(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("host"), "page_id", entry.alias("xml"))
    found = maps.select("host", F.explode(op.sitemap_locations(F.col("xml"))).alias("loc"))
    return found.groupBy("host").agg(F.count("loc").alias("n")).select("host", F.lit("sitemap").alias("kind"), "n")


@register(f"SELECT DISTINCT lower({HOST}) AS site, path, NOT (starts_with(path, '/en/') AND NOT starts_with(path, '/en/1')) AS allowed FROM (SELECT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def prd13_robots_allowed(spark, sf_dir):
    """robots rules of every site (English pages closed but for those that begin with 1) against its paths."""
    urls = read(spark, sf_dir, "pages").select(url.host(F.col("url")).alias("site"), url.path(F.col("url")).alias("path")).distinct()
    files = urls.select("site").distinct().withColumn("text", F.lit("User-agent: *\nDisallow: /en/ # closed\nAllow: /en/1\n"))
    return op.robots_allowed(urls, op.robots_rules(files), "reader")


#: Every host lists its pages in sitemaps of 10, every other one packed, every seventh cut off; an index names them.
PER_SITEMAP = 10
CHILD = "origin || '/sitemap-' || CASE WHEN c % 2 = 0 THEN 'privacy-' ELSE 'part-' END || c || CASE WHEN c % 4 < 2 THEN '.xml.gz' ELSE '.xml' END"


def site_files(spark, sf_dir):
    """(sites, robots, files) made of the pages table: what discovery reads."""
    origin = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    own = read(spark, sf_dir, "pages").select(origin.alias("origin"), "url", F.floor(F.col("page_id") / PER_SITEMAP).alias("c"), "page_id")
    entry = lambda x: F.concat(F.lit("<url><loc> "), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024</lastmod></url>"))
    lists = own.groupBy("origin", "c").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("rows"))  # at most PER_SITEMAP
    child = F.expr(CHILD)
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset>'), F.array_join(F.transform("rows", lambda r: entry(r["url"])), ""), F.lit("</urlset>"))
    plain = lists.select("origin", "c", child.alias("url"), xml.alias("xml"))

    @F.arrow_udf("binary")
    def packed(texts):
        import gzip

        import pyarrow as pa

        return pa.array([gzip.compress(t.encode(), mtime=0) for t in texts.to_pylist()], pa.binary())

    whole = F.when(F.col("url").endswith(".gz"), packed(F.col("xml"))).otherwise(F.encode("xml", "UTF-8"))
    files = plain.withColumn("whole", whole).select("url", F.when(F.col("c") % 7 == 3, F.substring("whole", 1, 20)).otherwise(F.col("whole")).alias("body"))
    names = lists.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("c", child.alias("url")))).alias("names"))
    index = F.concat(F.lit("<sitemapindex>"), F.array_join(F.transform("names", lambda n: F.concat(F.lit("<sitemap><loc>"), n["url"], F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>"))
    told = F.length("origin") % 2 == 0
    place = F.concat("origin", F.when(told, "/maps/all.xml").otherwise("/sitemap_index.xml"))
    tops = names.select(place.alias("url"), F.encode(index, "UTF-8").alias("body"))
    sites = names.select(F.col("origin").alias("site"), "origin")
    robots = names.where(told).select(F.col("origin").alias("site"), F.concat(F.lit("User-agent: *\r\nDisallow: /x # no\r\n sitemap : "), place).alias("text"))
    html = sites.select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.encode(F.lit("<!DOCTYPE html><html><urlset>no</urlset></html>"), "UTF-8").alias("body"))
    return sites, robots, files.unionByName(tops).unionByName(html)


SITEMAPS = f"""
own AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, url, page_id // {PER_SITEMAP} AS c FROM pages),
ranked AS (SELECT origin, c, row_number() OVER (PARTITION BY origin, c % 2 ORDER BY CASE WHEN c % 2 = 0 THEN 0 ELSE 0 END, {CHILD}) AS place FROM (SELECT DISTINCT origin, c FROM own)),
followed AS (SELECT *, {CHILD} AS sitemap FROM ranked WHERE place <= CASE WHEN c % 2 = 0 THEN 200 ELSE 8 END)"""


@register(f"WITH {SITEMAPS} SELECT origin AS site, url, 1 AS depth, min_by(sitemap, {{'kind': c % 2, 'c': c}}) AS sitemap FROM own JOIN followed USING (origin, c) WHERE c % 7 <> 3 GROUP BY origin, url")
def src14_sitemap_tree(spark, sf_dir):
    """Pages that sites list in packed and plain sitemaps below an index, found by robots texts or at well-known places."""
    found, _ = sitemaps.discover(*site_files(spark, sf_dir))
    return found


@register(f"WITH {SITEMAPS} SELECT origin AS site, sitemap AS url FROM followed WHERE c % 7 = 3 UNION ALL SELECT DISTINCT origin, origin || '/sitemap.xml' FROM own")
def src13_damaged_sitemaps(spark, sf_dir):
    """Files in a sitemap's place that are cut off, or pages."""
    _, damaged = sitemaps.discover(*site_files(spark, sf_dir))
    return damaged
