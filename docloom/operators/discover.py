"""What a site says about its own pages: sitemaps, llms.txt, robots.txt, canonical links; and page types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.crawl import normal_url

SITEMAP_DEPTH = 3


def is_html(content_type: Column) -> Column:
    """Empty, HTML or XHTML before any parameter."""
    kind = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    return kind.isin("", "text/html", "application/xhtml+xml")


def sitemap_entries(bodies: DataFrame) -> DataFrame:
    """url (of the sitemap), target, nested: the addresses that a sitemap or an index of sitemaps lists."""
    locations = F.regexp_extract_all("body", F.lit(r"(?is)<loc[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), 1)
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    return bodies.select("url", F.col("body").rlike(r"(?is)<sitemapindex[\s>]").alias("nested"), F.explode(locations).alias("target")).select("url", plain(F.col("target")).alias("target"), "nested")


def sitemap_pages(bodies: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct page addresses of the root sitemaps and those nested in them, to a bounded depth."""
    entries = sitemap_entries(bodies)
    level, found = roots.select("url").distinct(), None
    for _ in range(SITEMAP_DEPTH):
        here = entries.join(level, "url", "left_semi")
        pages = here.where(~F.col("nested")).select(F.col("target").alias("url"))
        found = pages if found is None else found.unionByName(pages)
        level = here.where("nested").select(F.col("target").alias("url")).distinct()
    return found.distinct()


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    """host, target: the sitemap lines of robots.txt bodies (host, body)."""
    lines = bodies.select("host", F.explode(F.split("body", r"\r\n|\r|\n")).alias("line"))
    return lines.where(F.col("line").rlike(r"(?i)^\s*sitemap\s*:")).select("host", F.trim(F.regexp_replace("line", r"(?i)^\s*sitemap\s*:", "")).alias("target")).where("target <> ''")


def manifest_links(bodies: DataFrame) -> DataFrame:
    """url, title, target, place: the Markdown links of llms.txt bodies, once each, at their first place."""
    text = F.regexp_extract_all("body", F.lit(r"\[([^\]]*)\]\(([^)\s]+)\)"), 1)
    to = F.regexp_extract_all("body", F.lit(r"\[([^\]]*)\]\(([^)\s]+)\)"), 2)
    links = bodies.select("url", F.posexplode(F.arrays_zip(text.alias("title"), to.alias("target"))).alias("place", "l"))
    return links.groupBy("url", "l.target").agg(F.min(F.struct("place", "l.title")).alias("f")).select("url", "f.title", "target", "f.place")


def page_of_twin(url: Column) -> Column:
    """The page that a Markdown twin stands for; null for any other address."""
    return F.when(url.rlike(r"(?i)\.md$"), F.regexp_replace(F.regexp_replace(url, r"(?i)\.md$", ""), r"/index$", "/"))


def is_manifest(url: Column) -> Column:
    return F.coalesce(url.rlike(r"/llms(-full)?\.txt([?#].*)?$"), F.lit(False))


def canonical(pages: DataFrame) -> DataFrame:
    """Adds canonical: the address that a page's head names, normalised; the page's own where it names none or a relative one."""
    tag = F.regexp_extract("html", r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*>", 0)
    target = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    return pages.withColumn("canonical", F.coalesce(normal_url(F.when(target != "", target)), normal_url(F.col("url"))))


def merged(pages: DataFrame) -> DataFrame:
    """One page for each canonical address: the one whose own address it is, else the first; adds copies."""
    own = F.struct((F.col("canonical") != normal_url(F.col("url"))).alias("other"), "url")
    rest = F.struct(*[c for c in pages.columns if c != "canonical"])
    return canonical(pages).groupBy("canonical").agg(F.min_by(rest, own).alias("p"), F.count("*").alias("copies")).select("canonical", "copies", "p.*")
