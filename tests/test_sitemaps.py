"""Sitemap files of every kind, and trees of them."""

import gzip

from pyspark.sql import functions as F

from vellum.sources import sitemaps

URLSET = "<urlset>{}</urlset>"
ONE = "<url><loc>{}</loc></url>"


def read(spark, rows):
    df = spark.createDataFrame(rows, "url string, body binary")
    text = sitemaps.body(F.col("url"), F.col("body"))
    return df.select("url", text.alias("t")).select("url", F.when(sitemaps.is_sitemap(F.col("t")), sitemaps.locations(F.col("t"))).alias("l"))


def test_files(spark):
    good = URLSET.format(ONE.format(" http://h/a?x=1&amp;y=2 ") + "<url>\n<image:loc>http://h/i</image:loc><loc><![CDATA[http://h/b]]></loc></url><url></url>")
    index = '<?xml version="1.0"?><sitemapindex xmlns="x"><sitemap><loc>http://h/s.xml</loc></sitemap><url><loc>http://h/no</loc></url></sitemapindex>'
    rows = [
        ("plain", good.encode()),
        ("zipped", gzip.compress(good.encode())),
        ("name.XML.GZ", good.encode()),  # called gzip, and is none
        ("cut", gzip.compress(good.encode())[:30]),
        ("html", b"  <!DOCTYPE html><urlset>"),
        ("index", index.encode()),
        ("empty", b""),
        ("null", None),
        ("bare", b"<?xml version='1.0'?><feed/>"),
        ("bomb", gzip.compress(b"<urlset>" + b" " * (sitemaps.MOST_BYTES + 1))),
        ("bytes", b"<urlset>\xff" + ONE.format("http://h/c").encode() + b"</urlset>"),
    ]
    found = {r["url"]: r["l"] for r in read(spark, rows).collect()}
    both = ["http://h/a?x=1&y=2", "http://h/b"]
    assert found == {"plain": both, "zipped": both, "name.XML.GZ": None, "cut": None, "html": None, "index": ["http://h/s.xml"], "empty": None, "null": None, "bare": [], "bomb": None, "bytes": ["http://h/c"]}


def test_trees(spark):
    origin = "http://h"
    children = [f"{origin}/sitemap-{i:02d}.xml" for i in range(12)] + [f"{origin}/sitemap-privacy.xml.gz", f"{origin}/sitemap-gone.xml"]
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"
    files = [(f"{origin}/named.xml", index.encode()), (f"{origin}/sitemap.xml", URLSET.format(ONE.format("http://h/1") + ONE.format("http://h/root")).encode())]
    files += [(c, URLSET.format(ONE.format(f"http://h/{i}") + ONE.format(f"http://h/sitemap-deep{i}.xml")).encode()) for i, c in enumerate(children[:12])]
    files += [(children[12], gzip.compress(URLSET.format(ONE.format("http://h/privacy")).encode()))]
    sites = spark.createDataFrame([("s", origin), ("none", "http://none")], "site string, origin string")
    robots = spark.createDataFrame([("s", "User-agent: *\r\nSITEMAP: http://h/named.xml # main"), ("none", None)], "site string, text string")
    pages, damaged = sitemaps.discover(sites, robots, spark.createDataFrame(files, "url string, body binary"))
    found = {r["url"]: (r["site"], r["depth"], r["sitemap"]) for r in pages.collect()}
    assert found["http://h/privacy"] == ("s", 1, children[12]) and found["http://h/root"] == ("s", 0, f"{origin}/sitemap.xml")
    assert found["http://h/1"] == ("s", 1, children[1])  # the robots text's index comes before the well-known place
    assert sum(v[1] == 1 and "deep" not in k for k, v in found.items()) == 1 + 8  # eight without a policy's name
    assert "http://h/sitemap-deep0.xml" in found and damaged.count() == 0
    bad = sitemaps.discover(sites, robots, spark.createDataFrame([(f"{origin}/named.xml", b"\x1f\x8bxx"), (f"{origin}/sitemap.xml", b"<urlset><url><loc>http://h/half</loc></url><ur")], "url string, body binary"))
    assert {r["url"] for r in bad[1].collect()} == {f"{origin}/named.xml", f"{origin}/sitemap.xml"}
    assert [r["url"] for r in bad[0].collect()] == ["http://h/half"]


def test_a_page_keeps_the_sitemap_that_its_index_names_first(spark):
    origin = "http://h"
    children = [f"{origin}/sitemap-privacy-{i}.xml" for i in (9, 10, 100)]
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"
    files = [(f"{origin}/sitemap.xml", index.encode())] + [(c, URLSET.format(ONE.format("http://h/same")).encode()) for c in children]
    sites, robots = spark.createDataFrame([("s", origin)], "site string, origin string"), spark.createDataFrame([], "site string, text string")
    pages, _ = sitemaps.discover(sites, robots, spark.createDataFrame(files, "url string, body binary"))
    assert [tuple(r) for r in pages.collect()] == [("s", "http://h/same", 1, children[0])]
