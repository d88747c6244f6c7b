"""Ranked search: BM25 over heading and text, pools, adjustments, ranks and the interleave.

``chunks`` has library_id, doc_id, chunk_id, ordinal, section, heading_path, text, kind. Statistics span a
whole library, whatever a search is narrowed to. A query's terms are known when the plan is made, so chunks
are never exploded into words: each chunk counts the query's terms in place, and a score is an expression
over those counts and its library's statistics. Texts stay out of the shuffles; join them back by chunk_id.
Counts are shuffled by document once, for the statistics and the scores alike, so a text is cut once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Fixed values of the ranking.
K1, B = 1.2, 0.75
INDEX_BOOST, KEYWORD_PENALTY = -2.0, 6.0
DEFAULT_K, MOST_K, POOL_FACTOR = 8, 200, 4
RELEVANCE_HALF = 10.0
PLACES = 6


@dataclass(frozen=True)
class Search:
    query: str
    k: int = DEFAULT_K
    section_filter: str | None = None
    include_keyword_reference: bool = False
    #: One document, or libraries by id; all where unset. Statistics span whole libraries all the same.
    doc_id: object = None
    libraries: tuple = ()

    @property
    def depth(self) -> int:
        return DEFAULT_K if self.k <= 0 else min(self.k, MOST_K)


def query_terms(query: str) -> list[str]:
    """Distinct lower-case words of a query; a query without one is an error."""
    found = list(dict.fromkeys(w.lower() for w in re.findall(r"[^\W]+", query)))
    if not found:
        raise ValueError("query contains no searchable terms")
    return found


FACTS = ("ordinal", "section", "heading_path", "kind")


def made(frame: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """``kept`` and new columns of a frame. They come out of inline(), through which no filter on them is pushed and which makes them all, and once."""
    return frame.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def counted(chunks: DataFrame, terms: list[str], holding: bool = False, facts: tuple = FACTS) -> DataFrame:
    """Keys and facts of every chunk, its length in words, tf, the counts of the query's terms in their order, and held, whether there are any.

    ``holding``: of the chunks that hold a term only; those without a term's letters are not cut. Words stand in one
    string, with a space between them, and their number is that of the spaces. A term is looked for only where its
    letters are, with a space on either side; the heading's words stand twice before the text's where it has a term's
    letters (it counts twice and is cut once). Each step is ``made``: a filter on tf would else cut the text anew for
    each term.
    """
    kept = ["library_id", "doc_id", "chunk_id", *[c for c in facts if c in chunks.columns]]
    low = made(chunks, kept, _heading_path=T.plain(F.replace("heading_path", F.lit(T.PATH_SEP), F.lit(" "))), _text=T.plain(F.col("text")))
    letters = [(F.contains("_heading_path", F.lit(t)), F.contains("_text", F.lit(t))) for t in terms]
    if holding:
        low = low.where(any_of([c for pair in letters for c in pair]))
    near = {f"_near{n}": in_heading | in_text for n, (in_heading, in_text) in enumerate(letters)}
    words = made(low, kept, _heading=T.joined(F.col("_heading_path"), T.parts), _words=T.joined(F.col("_text"), T.cut), _titled=any_of([h for h, _ in letters]), **near)
    space, length = F.lit(" "), T.word_count(F.col("_heading")) * 2 + T.word_count(F.col("_words"))
    wide = F.when(F.col("_titled"), F.concat(space, "_heading", space, "_heading", space, "_words", space)).when(any_of([F.col(c) for c in near]), F.concat(space, "_words", space)).otherwise("")
    tokens = made(words, [*kept, *near], _wide=wide, length=length.cast("long"))
    held = [F.col(c) & F.contains("_wide", F.lit(f" {t} ")) for c, t in zip(near, terms, strict=True)]
    if holding:
        tokens = tokens.where(any_of(held))
    tf = [F.when(h, T.times_held(F.col("_wide"), t)).otherwise(0) for h, t in zip(held, terms, strict=True)]
    return tokens.select(*kept, "length", F.array(*tf).alias("tf"), F.array(*held).alias("held"))


def by_document(counts: DataFrame, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """Counts twice: for the statistics, all of them, and for the scores, those that hold a term, which lie by document.

    Both come from one shuffle, which the second reader takes from the first (ReusedExchange), so chunks are cut into
    words once. The shuffle has a row for each chunk, with nothing but its length if it holds no term. It is only
    reused if it is the same for both, so nothing may be pushed below it for one of them: all columns are ``made``
    of it, and as the scores keep the keys as they are, for their order, a condition that is always true but not
    deterministic holds up filters on those.
    """
    facts = [c for c in counts.columns if c not in ("library_id", "doc_id", "length", "tf", "held")]
    keys = ["library_id", "doc_id"]
    rows = made(counts, [*keys, *facts], length=F.col("length"), _tf=F.col("tf"), _any=any_of([F.col("held")[n] for n in range(len(terms))]))
    spare = [F.when(F.col("_any"), F.col(c)).alias(f"_{c}") for c in facts]
    dealt = rows.select(*keys, *spare, "length", F.when(F.col("_any"), F.col("_tf")).alias("_tf")).repartition(*keys)
    row = {"length": F.col("length"), **{c: F.col(f"_{c}") for c in (*facts, "tf")}}
    every = made(dealt, [], **{c: F.col(c) for c in keys}, **row)
    held = made(dealt.where(F.monotonically_increasing_id() >= 0).where("_tf is not null"), keys, **row)
    return every.withColumn("held", F.array(*[F.coalesce(F.col("tf")[n] > 0, F.lit(False)) for n in range(len(terms))])), held


def library_statistics(counts: DataFrame, terms: list[str]) -> DataFrame:
    """library_id, chunks, mean_length and df (of the terms, in their order) of every library: one combined pass."""
    df = F.array(*[F.count_if(F.col("held")[n]) for n in range(len(terms))])
    return counts.groupBy("library_id").agg(F.count("*").alias("chunks"), F.avg("length").alias("mean_length"), df.alias("df"))


def term_statistics(statistics: DataFrame, terms: list[str]) -> DataFrame:
    """library_id, term, df, chunks, mean_length of the terms that a library holds."""
    named = F.arrays_zip(F.array(*map(F.lit, terms)).alias("term"), F.col("df").alias("df"))
    rows = statistics.select("library_id", "chunks", "mean_length", F.explode(named).alias("t"))
    return rows.select("library_id", "t.term", "t.df", "chunks", "mean_length").where("df > 0")


def scored(counts: DataFrame, terms: list[str], statistics: DataFrame, keys: list[str]) -> DataFrame:
    """Adds bm25 to counts by their statistics, which are joined by the keys."""

    def part(n: int) -> Column:
        tf, df = F.col("tf")[n], F.col("df")[n]
        idf = F.log1p((F.col("chunks") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))).otherwise(F.lit(0.0))

    score = part(0)
    for n in range(1, len(terms)):
        score = score + part(n)
    return counts.join(statistics, keys).withColumn("bm25", F.round(-score, PLACES)).drop("tf", "held", "df", "length", "chunks", "mean_length")


def bm25(chunks: DataFrame, terms: list[str], ready: DataFrame | None = None, narrow: Column | None = None, facts: tuple = FACTS) -> DataFrame:
    """Keys, facts and bm25 (negative: lower is better) of the chunks that hold a term; those of ready documents, where given.

    A score is an expression over the chunk's own counts and its library's statistics. The statistics are joined to the
    ready documents first, so the counts are shuffled by document, never by library. ``narrow`` is a condition on keys
    and facts that is checked before a chunk is cut: those under it are cut anew, all for the statistics.
    """
    if narrow is None:
        counts, held = by_document(counted(chunks, terms, facts=facts), terms)
    else:
        counts, held = counted(chunks, terms), counted(chunks, terms, holding=True).where(narrow)
    statistics, keys = library_statistics(counts, terms), ["library_id"]
    if ready is not None:
        statistics, keys = ready.select("library_id", "doc_id").distinct().join(statistics, "library_id"), ["library_id", "doc_id"]
    return scored(held, terms, statistics, keys)


def relevance(score: Column) -> Column:
    s = F.greatest(-score, F.lit(0.0))
    return F.round(s / (s + RELEVANCE_HALF), PLACES)


def term_sections(index_terms: DataFrame, query: str) -> DataFrame:
    """library_id, doc_id, section of index terms that hold a query word of three bytes or more."""
    long_words = [w for w in query_terms(query) if len(w.encode()) >= 3]
    held = F.lit(False)
    for w in long_words:
        held = held | F.contains(F.lower("term"), F.lit(w))
    return index_terms.where(held).select("library_id", "doc_id", "section").distinct()


def boosted(found: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds matched_book_index: whether a row's section lies under a matched one of its document.

    The matched sections come as one list a document, so the rows are made once and stay where their documents are.
    """
    wanted = sections.where("section is not null").groupBy("library_id", "doc_id").agg(F.collect_set("section").alias("_wanted"))
    under = (F.length("section") > 0) & F.arrays_overlap(T.ancestors(F.col("section")), F.col("_wanted"))
    return found.join(wanted, ["library_id", "doc_id"], "left").withColumn("matched_book_index", F.coalesce(under, F.lit(False))).drop("_wanted")


def pools(chunks: DataFrame, ready: DataFrame, search: Search, facts: tuple = FACTS) -> DataFrame:
    """The best 4k chunks of each ready document by raw score, with pool_rank and their facts."""
    narrow = []
    if search.section_filter:
        narrow.append(T.within_section(F.col("heading_path"), search.section_filter))
    if search.doc_id is not None:
        narrow.append(F.col("doc_id") == search.doc_id)
    if search.libraries:
        narrow.append(F.col("library_id").isin(*search.libraries))
    scores = bm25(chunks, query_terms(search.query), ready, reduce(and_, narrow) if narrow else None, facts)
    order = Window.partitionBy("library_id", "doc_id").orderBy("bm25", "chunk_id")
    return scores.withColumn("pool_rank", F.row_number().over(order)).where(F.col("pool_rank") <= POOL_FACTOR * search.depth)


def ranked(chunks: DataFrame, ready: DataFrame, search: Search, index_terms: DataFrame | None = None, facts: tuple = FACTS) -> DataFrame:
    """Adds adjusted, matched_book_index, doc_rank and relevance to pools, cut to k a document."""
    found = pools(chunks, ready, search, facts)
    if index_terms is not None:
        found = boosted(found, term_sections(index_terms, search.query))
    else:
        found = found.withColumn("matched_book_index", F.lit(False))
    penalty = F.lit(0.0) if search.include_keyword_reference else F.when(F.col("kind") == "keyword-reference", KEYWORD_PENALTY).otherwise(0.0)
    adjusted = F.col("bm25") + F.when(F.col("matched_book_index"), INDEX_BOOST).otherwise(0.0) + penalty
    order = Window.partitionBy("library_id", "doc_id").orderBy("adjusted", "pool_rank")
    return (
        found.withColumn("adjusted", F.round(adjusted, PLACES))
        .withColumn("doc_rank", F.row_number().over(order))
        .where(F.col("doc_rank") <= search.depth)
        .withColumn("relevance", relevance(F.col("adjusted")))
    )


def interleaved(results: DataFrame, k: int) -> DataFrame:
    """All first ranks by score, then all second ranks, until k; adds rank."""
    best = results.orderBy("doc_rank", "adjusted", "library_id", "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("doc_rank", "adjusted", "library_id", "doc_id")))


def search(chunks: DataFrame, ready: DataFrame, request: Search, index_terms: DataFrame | None = None, facts: tuple = FACTS) -> DataFrame:
    """Results of one query over all documents and libraries that the frames hold.

    ``facts``: those of FACTS that results carry. A rank needs kind and, with index terms, section.
    """
    return interleaved(ranked(chunks, ready, request, index_terms, facts), request.depth)
