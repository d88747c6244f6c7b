"""What sites say about their pages."""

from pyspark.sql import functions as F

from docloom.operators import discover


def test_sitemaps(spark):
    rows = [("root", "<sitemapindex><sitemap><loc> a </loc></sitemap></sitemapindex>"), ("a", "<urlset><url><loc>http://x/1?a=1&amp;b=2</loc></url><url><LOC><![CDATA[http://x/2]]></LOC></url></urlset>"), ("b", "<urlset><loc>http://x/3</loc></urlset>")]
    bodies = spark.createDataFrame(rows, "url string, body string")
    got = discover.sitemap_pages(bodies, spark.createDataFrame([("root",)], "url string")).collect()
    assert {r.url for r in got} == {"http://x/1?a=1&b=2", "http://x/2"}


def test_robots_and_manifests(spark):
    robots = spark.createDataFrame([("h", "User-agent: *\r\nSITEMAP: http://h/s.xml\nDisallow: /")], "host string, body string")
    assert [(r.host, r.target) for r in discover.robots_sitemaps(robots).collect()] == [("h", "http://h/s.xml")]
    bodies = spark.createDataFrame([("u", "# T\n- [One](http://h/1): x\n- [Two](http://h/2.md)\n- [Again](http://h/1)")], "url string, body string")
    got = {(r.title, r.target, r.place) for r in discover.manifest_links(bodies).collect()}
    assert got == {("One", "http://h/1", 0), ("Two", "http://h/2.md", 1)}
    row = spark.range(1).select(discover.page_of_twin(F.lit("http://h/a.md")).alias("a"), discover.page_of_twin(F.lit("http://h/a")).alias("b"), discover.is_manifest(F.lit("http://h/llms.txt")).alias("c"), discover.is_html(F.lit("Text/HTML; charset=x")).alias("d"), discover.is_html(F.lit("text/plain")).alias("e")).first()
    assert tuple(row) == ("http://h/a", None, True, True, False)


def test_canonical_pages_merge(spark):
    link = '<head><LINK href="http://H/a" rel="canonical"></head>'
    pages = spark.createDataFrame([("http://h/a?x", link), ("http://h/a", "<p>"), ("http://h/b", "<p>")], "url string, html string")
    got = {r.canonical: (r.url, r.copies) for r in discover.merged(pages).collect()}
    assert got == {"http://h/a": ("http://h/a", 2), "http://h/b": ("http://h/b", 1)}
