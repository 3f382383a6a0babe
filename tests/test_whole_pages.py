"""Pages that repeat a link, and links of several parameters, are not left out."""

from vellum import catalog

HTML = '<html lang="en"><body><a href="http://h/a">1</a><a href="http://h/a">2</a><a href="http://h/b?x=1&amp;y=2">3</a></body></html>'


def test_all_pages_and_links(spark, tmp_path):
    spark.createDataFrame([(1, "http://h/", HTML), (2, "http://h/2", '<html lang="de"><a href="http://h/a">x</a></html>')], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    q = catalog.queries()
    assert sorted(map(tuple, q["src10_html_metadata_all"](spark, str(tmp_path)).select("page_id", "lang", "n_links").collect())) == [(1, "en", 2), (2, "de", 1)]
    assert sorted(map(tuple, q["ded9_link_table_all"](spark, str(tmp_path)).select("url", "n_pages").collect())) == [("http://h/a", 2), ("http://h/b?x=1&y=2", 1)]
