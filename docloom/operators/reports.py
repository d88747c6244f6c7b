"""The listings and reports that users see: documents, verification, grouped results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import grade, navigate


def list_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ready documents with their chunk count and first headings, joined by semicolons in order."""
    heads = navigate.top_headings(chunks).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "heading"))).alias("h"))
    named = heads.select("doc_id", F.array_join(F.transform("h", lambda x: x["heading"]), "; ").alias("headings"))
    return documents.where("status = 'ready'").join(named, "doc_id", "left").select("library_id", "doc_id", "title", "chunk_count", F.coalesce("headings", F.lit("")).alias("headings"))


#: What the reports need of a chunk beside its text.
SLIM = ("doc_id", "ordinal", "section", "heading_path", "page_start", "page_end", "image_count", "tokens")


def verify(documents: DataFrame, chunks: DataFrame, index_terms: DataFrame) -> DataFrame:
    """One row a document: sizes, integrity problems by kind, and the verdict. ``chunks`` has tokens.

    The chunks are written once without their texts, so that texts are cut and sized once, not for each problem.
    """
    from docloom.llm.shared import written

    counted = lambda frame, name: frame.groupBy("doc_id").agg(F.count("*").alias(name))
    slim = written(chunks.select(*SLIM), "chunks")
    judged = grade.judged(grade.findings(slim, keys=grade.line_keys(chunks)), documents)
    problems = {
        "ordinal_gaps": counted(grade.ordinal_gaps(slim), "ordinal_gaps"),
        "scattered": counted(grade.scattered_sections(slim), "scattered"),
        "uncovered_pages": counted(grade.uncovered_pages(slim, documents), "uncovered_pages"),
        "unjoinable": counted(navigate.unjoinable_sections(index_terms, slim), "unjoinable"),
    }
    out = documents.select("doc_id", "status", "chunk_count").join(grade.token_spread(slim), "doc_id", "left")
    for frame in problems.values():
        out = out.join(frame, "doc_id", "left")
    return out.join(judged, "doc_id").na.fill(0, [*problems, "findings"]).select(
        "doc_id", "status", "chunk_count", "token_median", "token_p95", "token_mean", *problems, "findings", "verdict"
    )


def grouped_results(results: DataFrame) -> DataFrame:
    """Results by document: documents in the order of their best, each with its chunks in rank order."""
    return (
        results.groupBy("library_id", "doc_id")
        .agg(F.min("rank").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("hits"))
        .select("library_id", "doc_id", "best", F.array_join(F.transform("hits", lambda h: h["chunk_id"].cast("string")), ",").alias("chunk_ids"))
    )


def figure_notes(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id of results whose chunk is mostly figures: two images or more over a short text."""
    short = chunks.where((F.col("image_count") >= 2) & (F.octet_length("text") < 800)).select("chunk_id")
    return results.join(short, "chunk_id", "left_semi").select("chunk_id")
