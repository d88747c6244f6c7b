"""Rules over the primitives of paginated files: lines with geometry, images, outlines, headings.

No PDF library is assumed: a reader of any kind fills ``lines`` (doc_id, page from 1, line_no, size, y0, text),
``images`` (doc_id, page, image_id, area, y0), ``outline`` (doc_id, entry_no, level, title, page) and
``headings`` (doc_id, heading_no, section, page). All rules but the outline's counters are grouped plans over
all documents at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
HEADING_RATIO, HEADING_LINES, PAGES_A_LINE = 1.10, 5, 400
FURNITURE_PAGES, FURNITURE_SHARE, FURNITURE_LEAST, FURNITURE_SPREAD = 8, 0.25, 3, 6.0
FIGURE_PAGES, FIGURE_AREA = 0.5, 400.0
PAGE_OF = r"^\p{Nd}+\s+of\s+\p{Nd}+$"
SECTION = r"[0-9]+(?:\.[0-9]+)*"
INDEX_ROW = rf"^(.*?)\s+((?:{SECTION}\.\s*)+)$"


def line_key(text: Column) -> Column:
    """The spelling under which repeated lines count as one; digits of every script fold."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\p{Nd}+", "#")


def fonts(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, body (the size that carries most characters, first seen among equals), headings (sizes, largest first).

    A heading size is a tenth larger than the body and established by its number of lines; any size as large
    as the least established one is a heading, however rare. ``documents`` has doc_id and page_count.
    """
    first = F.min(F.struct("page", "line_no"))
    sizes = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("volume"), F.count("*").alias("n"), first.alias("first"))
    order = F.struct(F.col("volume"), -F.col("first.page"), -F.col("first.line_no"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", order).alias("body"))
    floor = documents.select("doc_id", F.greatest(F.lit(HEADING_LINES), F.floor(F.col("page_count") / PAGES_A_LINE)).alias("floor"))
    known = sizes.join(body, "doc_id").join(floor, "doc_id")
    least = known.where((F.col("size") >= F.col("body") * HEADING_RATIO) & (F.col("n") >= F.col("floor"))).groupBy("doc_id").agg(F.min("size").alias("least"))
    heads = sizes.join(least, "doc_id").where(F.col("size") >= F.col("least")).groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list("size"))).alias("headings"))
    return body.join(heads, "doc_id", "left").select("doc_id", "body", F.coalesce("headings", F.array().cast("array<double>")).alias("headings"))


def furniture(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, line_key of lines that stand on a quarter of a document's pages.

    Lines with a letter count their pages; lines without one count only pages on which they stand at one
    height, the most of any band. The band is a range window over heights, and its pages a set.
    """
    keyed = lines.select("doc_id", "page", "y0", line_key(F.col("text")).alias("line_key")).where(F.length("line_key") > 0)
    limits = documents.where(F.col("page_count") >= FURNITURE_PAGES).select("doc_id", F.greatest(F.lit(FURNITURE_LEAST), F.floor(F.col("page_count") * FURNITURE_SHARE)).alias("limit"))
    lettered = keyed.where(F.col("line_key").rlike(r"\p{L}")).select("doc_id", "line_key", "page").distinct().groupBy("doc_id", "line_key").agg(F.count("*").alias("pages"))
    micro = (F.col("y0") * 1000).cast("long")
    band = Window.partitionBy("doc_id", "line_key").orderBy(micro).rangeBetween(-int(FURNITURE_SPREAD * 1000), 0)
    bare = keyed.where(~F.col("line_key").rlike(r"\p{L}")).withColumn("on", F.size(F.collect_set("page").over(band))).groupBy("doc_id", "line_key").agg(F.max("on").cast("long").alias("pages"))
    return lettered.unionByName(bare).join(limits, "doc_id").where(F.col("pages") >= F.col("limit")).select("doc_id", "line_key")


def without_furniture(lines: DataFrame, documents: DataFrame) -> DataFrame:
    """Lines that are neither repeated nor of the form 3 of 12."""
    keyed = lines.withColumn("line_key", line_key(F.col("text"))).where(~F.col("text").rlike(PAGE_OF))
    return keyed.join(furniture(lines, documents), ["doc_id", "line_key"], "left_anti").drop("line_key")


def figures(images: DataFrame, documents: DataFrame) -> DataFrame:
    """Images that are figures: not on most pages, not tiny, once a page (the topmost)."""
    pages = images.select("doc_id", "image_id", "page").distinct().groupBy("doc_id", "image_id").agg(F.count("*").alias("on"))
    common = pages.join(documents.select("doc_id", "page_count"), "doc_id").where(F.col("on") > F.col("page_count") * FIGURE_PAGES).select("doc_id", "image_id")
    once = Window.partitionBy("doc_id", "page", "image_id").orderBy("y0")
    kept = images.where(F.col("area") >= FIGURE_AREA).join(common, ["doc_id", "image_id"], "left_anti")
    return kept.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def numbered_outline(outline: DataFrame) -> DataFrame:
    """Adds section: dotted numbers by nesting. A level's number starts anew under each entry of the level above.

    An entry's number at level l counts the entries of that level since the last entry of a lesser level; the
    numbers above it are those of the last entries there, 0 where a level was skipped.
    """
    deepest = 9
    w = Window.partitionBy("doc_id").orderBy("entry_no")
    out = outline
    for level in range(1, deepest + 1):
        # the run since the last entry above this level
        out = out.withColumn("_run", F.count_if(F.col("level") < level).over(w))
        run = Window.partitionBy("doc_id", "_run").orderBy("entry_no")
        out = out.withColumn(f"_{level}", F.count_if(F.col("level") == level).over(run))
    parts = F.slice(F.array(*[F.col(f"_{n}") for n in range(1, deepest + 1)]), F.lit(1), F.col("level"))
    return out.withColumn("section", F.array_join(F.transform(parts, lambda n: n.cast("string")), ".")).drop("_run", *[f"_{n}" for n in range(1, deepest + 1)])


def cross_validation(contents: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id with the sections that only the contents or only the body have, and those found more than once.

    ``contents`` has doc_id, section. Without contents nothing counts as extra.
    """
    body = headings.groupBy("doc_id", "section").agg(F.count("*").alias("n"))
    both = contents.select("doc_id", "section").distinct().withColumn("_toc", F.lit(True)).join(body, ["doc_id", "section"], "full")
    some = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("section"))))
    out = both.groupBy("doc_id").agg(
        F.count_if(F.col("_toc")).alias("toc_sections"),
        F.count("n").alias("body_sections"),
        some(F.col("n").isNull()).alias("in_toc_not_in_body"),
        some(F.col("_toc").isNull()).alias("_extra"),
        some(F.col("n") > 1).alias("detected_more_than_once"),
    )
    return out.withColumn("in_body_not_in_toc", F.when(F.col("toc_sections") > 0, F.col("_extra")).otherwise(F.array().cast("array<string>"))).drop("_extra")


def page_offset(contents: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, offset: the most common difference of a heading's page and the page its contents print (first seen among equals)."""
    offsets = headings.join(contents.select("doc_id", "section", F.col("page").alias("printed")), ["doc_id", "section"]).withColumn("offset", F.col("page") - F.col("printed"))
    counts = offsets.groupBy("doc_id", "offset").agg(F.count("*").alias("n"), F.min("heading_no").alias("first"))
    return counts.groupBy("doc_id").agg(F.max_by("offset", F.struct(F.col("n"), -F.col("first"))).alias("offset"))


def index_entries(rows: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, term, section of index rows (``term 1.2. 3.4.``) whose sections are known."""
    row = F.trim("text")
    refs = F.regexp_extract_all(F.regexp_extract(row, INDEX_ROW, 2), F.lit(SECTION), 0)
    found = rows.select("doc_id", F.trim(F.regexp_extract(row, INDEX_ROW, 1)).alias("term"), F.explode(refs).alias("section"))
    return found.where("term <> ''").distinct().join(known.select("doc_id", "section"), ["doc_id", "section"], "left_semi").select("doc_id", "term", "section")
