"""The structure report of documents: what extraction and chunking noticed, its quality, its JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import grade

#: Fixed values.
PIPELINE_VERSION = 3
INCOMPLETE, ADDRESSABLE_MIN, UNDIVIDED, JUDGED_FROM, HEADLESS, SCRIPT_DEGRADED, SAMPLES = 0.20, 0.50, 0.50, 25, 0.02, 0.50, 200
MARKED_UP = ("atx_headings", "html_nesting", "heading_styles")
SUBJECTS = 10

_STRINGS = "array<string>"
DIAGNOSTICS = {
    "structure_source": "string",
    "toc_sections": "int",
    "body_sections": "int",
    "in_toc_not_in_body": _STRINGS,
    "in_body_not_in_toc": _STRINGS,
    "detected_more_than_once": _STRINGS,
    "pages_declared": "int",
    "pages_fetched": "int",
    "unreachable_pages": _STRINGS,
}


def sampled_script_share(chunks: DataFrame) -> DataFrame:
    """doc_id, script_share over about two hundred chunks spread evenly; counts are added, texts never joined."""
    w = Window.partitionBy("doc_id")
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / SAMPLES))
    picked = chunks.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy("ordinal")) - 1).where(F.col("_k") % stride == 0)
    odd, letters = F.regexp_count("text", F.lit(T.UNCALIBRATED)), F.regexp_count("text", F.lit(r"\p{L}"))
    sums = picked.groupBy("doc_id").agg(F.sum(odd).alias("a"), F.sum(letters).alias("b"))
    return sums.select("doc_id", F.when(F.col("b") > 0, T.round3(F.col("a") / F.col("b"))).otherwise(0.0).alias("script_share"))


def report(chunks: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row a document: measures of its chunks beside the diagnostics (doc_id and columns of DIAGNOSTICS; missing ones are empty)."""
    told = diagnostics
    for name, kind in DIAGNOSTICS.items():
        empty = F.array().cast(kind) if kind == _STRINGS else F.lit("" if kind == "string" else 0).cast(kind)
        told = told.withColumn(name, F.coalesce(F.col(name).cast(kind), empty) if name in told.columns else empty)
    scattered = grade.scattered_sections(chunks).groupBy("doc_id").agg(F.array_sort(F.collect_list("section")).alias("scattered_sections"))
    out = told.select("doc_id", *DIAGNOSTICS).join(grade.section_counts(chunks), "doc_id", "left").join(scattered, "doc_id", "left").join(sampled_script_share(chunks), "doc_id", "left")
    return out.select(
        "doc_id",
        *DIAGNOSTICS,
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("headless", F.lit(0)).alias("headless_chunks"),
        F.coalesce("paths", F.lit(0)).alias("distinct_heading_paths"),
        F.coalesce("largest", F.lit("")).alias("largest_section_path"),
        F.coalesce("largest_size", F.lit(0)).alias("largest_section_chunks"),
        F.coalesce("scattered_sections", F.array().cast(_STRINGS)).alias("scattered_sections"),
        F.coalesce("script_share", F.lit(0.0)).alias("uncalibrated_script_share"),
        F.lit(PIPELINE_VERSION).alias("pipeline_version"),
    )


def symmetric_difference() -> Column:
    return F.array_sort(F.array_union(F.array_except("in_toc_not_in_body", "in_body_not_in_toc"), F.array_except("in_body_not_in_toc", "in_toc_not_in_body")))


def checks() -> dict[str, Column]:
    """Conditions over a report's columns."""
    chunks = F.col("chunks")
    judged = chunks >= JUDGED_FROM
    undivided = judged & (F.col("largest_section_chunks") / chunks >= UNDIVIDED)
    marked = F.col("structure_source").isin(*MARKED_UP)
    return {
        "undivided": undivided,
        "unaddressable": undivided | (judged & ~marked & (F.col("distinct_heading_paths") / chunks < ADDRESSABLE_MIN)),
        "mostly_headless": (chunks > 0) & (F.col("headless_chunks") / chunks >= HEADLESS),
        "incomplete": (F.col("pages_declared") > 0) & (F.size("unreachable_pages") / F.col("pages_declared") >= INCOMPLETE),
        "disagrees": (F.col("toc_sections") > 0) & (F.col("body_sections") > 0) & (F.size(symmetric_difference()) > 0),
        "unscripted": F.col("uncalibrated_script_share") >= SCRIPT_DEGRADED,
        "repeats": F.size("detected_more_than_once") > 0,
        "scattered": F.size("scattered_sections") > 0,
    }


def graded(reports: DataFrame) -> DataFrame:
    """Adds notes (names of the checks that hold), quality (failed, degraded, ok) and the report as JSON."""
    held = checks()
    body = F.to_json(F.struct(*[c for c in reports.columns if c != "doc_id"]))
    notes = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in held.items()]))
    fatal = F.arrays_overlap(F.col("notes"), F.array(F.lit("incomplete"), F.lit("disagrees")))
    return reports.withColumn("warnings", body).withColumn("notes", notes).withColumn("quality", F.when(fatal, "failed").when(F.size("notes") > 0, "degraded").otherwise("ok"))


def read_back(documents: DataFrame, column: str = "warnings") -> DataFrame:
    """Adds version, structure_source and scattered (ten names, then how many more) from stored JSON; unreadable JSON gives nulls."""
    found = F.from_json(column, "structure_source string, pipeline_version int, scattered_sections array<string>")
    names = F.col("_r.scattered_sections")
    more = F.when(F.size(names) > SUBJECTS, F.concat(F.lit(" (+"), F.size(names) - SUBJECTS, F.lit(" more)"))).otherwise("")
    return (
        documents.withColumn("_r", found)
        .withColumn("version", F.col("_r.pipeline_version"))
        .withColumn("structure_source", F.col("_r.structure_source"))
        .withColumn("scattered", F.when(names.isNotNull(), F.concat(F.array_join(F.slice(names, 1, SUBJECTS), ", "), more)))
        .drop("_r")
    )
