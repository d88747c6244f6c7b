"""Outlines, context windows, page ranges, section matches and samples over chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Fixed values.
CONTEXT_TOKENS, CONTEXT_SIDE, PAGES_AT_ONCE, TOP_HEADINGS = 6000, 50, 20, 15
READ_DEFAULT, READ_MOST = 40, 200


def outline(chunks: DataFrame, depth: int = 2) -> DataFrame:
    """Every heading once, where it first occurs; a heading that ends a path carries its chunk."""
    first = Window.partitionBy("doc_id", "heading").orderBy("ordinal", "level")
    parts = F.slice(T.path_parts(F.col("heading_path")), 1, depth)
    return (
        chunks.where(F.length("heading_path") > 0)
        .select("doc_id", "ordinal", "chunk_id", "section", T.depth(F.col("heading_path")).alias("whole"), parts.alias("parts"))
        .select("*", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("level"))
        .withColumn("heading", F.array_join(F.slice("parts", F.lit(1), F.col("level")), T.PATH_SEP))
        .withColumn("n", F.row_number().over(first))
        .where("n = 1")
        .select("doc_id", "ordinal", "level", "heading", F.when(F.col("level") == F.col("whole"), F.col("chunk_id")).alias("chunk_id"))
    )


def context_span(chunks: DataFrame, anchors: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """Neighbours of each anchor (doc_id, anchor ordinal); sides are clamped, none at all means one each."""
    before, after = min(max(before, 0), CONTEXT_SIDE), min(max(after, 0), CONTEXT_SIDE)
    if before == after == 0:
        before = after = 1
    wanted = anchors.select("doc_id", "anchor", F.explode(F.sequence(F.col("anchor") - before, F.col("anchor") + after)).alias("ordinal"))
    return chunks.join(wanted, ["doc_id", "ordinal"])


def trimmed(span: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """Drops from the front up to the anchor, then from the back, until the budget holds; the anchor stays.

    ``span`` has doc_id, anchor, ordinal, tokens.
    """
    whole = Window.partitionBy("doc_id", "anchor").orderBy("ordinal")
    suffix = F.sum("tokens").over(whole.rowsBetween(0, Window.unboundedFollowing))
    kept = span.withColumn("_suffix", suffix).where((F.col("ordinal") >= F.col("anchor")) | (F.col("_suffix") <= budget))
    prefix = F.sum("tokens").over(whole.rowsBetween(Window.unboundedPreceding, 0))
    # what stands before the anchor stays only if all fits, so the back is cut from what is left now
    return kept.withColumn("_prefix", prefix).where((F.col("ordinal") <= F.col("anchor")) | (F.col("_prefix") <= budget)).drop("_suffix", "_prefix")


def passages(chunks: DataFrame, start: int = 0, limit: int = READ_DEFAULT) -> DataFrame:
    """A run of chunks of each document from an ordinal on; a limit out of range is the default, not the most."""
    start = max(start, 0)
    limit = limit if 0 < limit <= READ_MOST else READ_DEFAULT
    return chunks.where(F.col("ordinal").between(start, start + limit - 1))


def heading_contains(chunks: DataFrame, text: str) -> DataFrame:
    """Chunks whose heading path holds a text, whatever its case; nothing in it is a wildcard."""
    return chunks.where(F.contains(F.lower("heading_path"), F.lower(F.lit(text))))


def with_prefix(documents: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column starts with a text; nothing in it is a wildcard, and the scan gets it as a pushed filter."""
    return documents.where(F.startswith(F.col(column), F.lit(prefix)))


def pages_in(pages: DataFrame, start: int, end: int) -> DataFrame:
    """Pages of a range of at most twenty; an end before the start is the start. Adds truncated."""
    end = max(start, end)
    last = min(end, start + PAGES_AT_ONCE - 1)
    return pages.where(F.col("page").between(start, last)).withColumn("truncated", F.lit(last < end))


def top_headings(chunks: DataFrame, most: int = TOP_HEADINGS) -> DataFrame:
    """The first distinct top headings of each document, in order."""
    tops = chunks.where(F.length("heading_path") > 0).groupBy("doc_id", T.top(F.col("heading_path")).alias("heading")).agg(F.min("ordinal").alias("first"))
    order = Window.partitionBy("doc_id").orderBy("first", "heading")
    return tops.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def stride_sample(chunks: DataFrame, stride: int) -> DataFrame:
    """Every n-th chunk of each document in order, with its place."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    return chunks.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") % max(stride, 1) == 0)


def chunks_in_sections(chunks: DataFrame, references: DataFrame) -> DataFrame:
    """Pairs of a reference (doc_id, reference) and the chunks whose section lies under it."""
    return (
        chunks.where(F.length("section") > 0)
        .select("doc_id", "chunk_id", "section", F.explode(T.ancestors(F.col("section"))).alias("reference"))
        .join(references.where(F.length("reference") > 0).select("doc_id", "reference").distinct(), ["doc_id", "reference"])
    )


def unjoinable_sections(index_terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections that an index names and no chunk lies under."""
    named = index_terms.select("doc_id", "section").distinct()
    held = chunks.where(F.length("section") > 0).select("doc_id", F.explode(T.ancestors(F.col("section"))).alias("section"))
    return named.join(held, ["doc_id", "section"], "left_anti")
