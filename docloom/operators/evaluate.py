"""Retrieval evaluation: recall at depths by groups, self-labelled queries, index share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

DEPTHS = (1, 3, 8, 20)
#: Words that say nothing in a query; a fixed list of the evaluation.
QUERY_WORDS, QUERY_WORD_BYTES = 4, 5


def recall(hits: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """grouping, value, queries and recall at each depth over all queries, blind ones, categories and documents.

    ``hits`` has a row for each query: doc_id, category, blind, rank (null where it was missed).
    """
    every = hits.select(
        "rank",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("all").alias("grouping"), F.lit("").alias("value")),
                    F.when(F.col("blind"), F.struct(F.lit("blind").alias("grouping"), F.lit("").alias("value"))),
                    F.struct(F.lit("category").alias("grouping"), F.col("category").alias("value")),
                    F.struct(F.lit("document").alias("grouping"), F.col("doc_id").cast("string").alias("value")),
                ),
                lambda g: g.isNotNull(),
            )
        ).alias("g"),
    )
    return every.groupBy("g.grouping", "g.value").agg(
        F.count("*").alias("queries"), *[F.round(F.avg(F.when(F.col("rank") <= d, 1.0).otherwise(0.0)), 6).alias(f"recall_{d}") for d in depths]
    )


def self_query(heading_path: Column, text: Column) -> Column:
    """A query for a chunk: its leaf heading and the four longest new words of its text (ties in text order)."""
    heading = T.words(T.leaf(heading_path))
    body = F.filter(F.array_distinct(T.words(text)), lambda w: (F.octet_length(w) >= QUERY_WORD_BYTES) & ~F.array_contains(heading, w))
    placed = F.transform(body, lambda w, n: F.struct((-F.octet_length(w)).alias("size"), n.alias("n"), w.alias("w")))
    longest = F.transform(F.slice(F.array_sort(placed), 1, QUERY_WORDS), lambda s: s["w"])
    return F.trim(F.concat_ws(" ", T.leaf(heading_path), F.array_join(longest, " ")))


def overlap(text: Column, terms: list[str]) -> Column:
    """How many of the terms (lower case) a text holds, inside words too."""
    body = F.lower(text)
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(body, t)))


def best_overlap(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, heading_path, found: each document's chunk that holds the most terms, the first among equals."""
    found = chunks.select("doc_id", "heading_path", "ordinal", overlap(F.concat_ws(" ", "heading_path", "text"), terms).alias("found"))
    return found.groupBy("doc_id").agg(F.max_by(F.struct("heading_path", "found"), F.struct("found", -F.col("ordinal"))).alias("b")).select("doc_id", "b.*")


def index_share(chunks: DataFrame) -> DataFrame:
    """library_id, doc_id, share of its library's chunks."""
    per = chunks.groupBy("library_id", "doc_id").agg(F.count("*").alias("n"))
    total = per.groupBy("library_id").agg(F.sum("n").alias("total"))
    return per.join(total, "library_id").select("library_id", "doc_id", F.round(F.col("n") / F.col("total"), 9).alias("share"))
