"""The registered queries of the engine's own operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import access, crawl, evaluate, grade, jobs, navigate, reports, search
from docloom.plans import corpus as C

Query = Callable[[SparkSession, str], DataFrame]

#: The query words of the search queries.
WORDS = "the license of version"
RESULT = ("library_id", "doc_id", "chunk_id", "adjusted", "doc_rank", "relevance", "rank")


def _facts(with_terms: bool = False) -> tuple:
    """The facts of a chunk that its rank needs; results do not show the others."""
    return ("kind", "section") if with_terms else ("kind",)


def _searched(request: search.Search, with_terms: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        terms = C.index_terms(spark, d) if with_terms else None
        return search.search(C.chunks(spark, d), C.ready(spark, d), request, terms, _facts(with_terms)).select(*RESULT)

    return run


def bm25_pool(spark: SparkSession, d: str) -> DataFrame:
    return search.pools(C.chunks(spark, d), C.ready(spark, d), search.Search(WORDS, k=2), ()).select("library_id", "doc_id", "chunk_id", "bm25", "pool_rank")


def bm25_interleave(spark: SparkSession, d: str) -> DataFrame:
    found = search.ranked(C.chunks(spark, d), C.ready(spark, d), search.Search(WORDS, k=3), facts=_facts())
    return found.select("library_id", "doc_id", "chunk_id", "adjusted", "doc_rank", "relevance")


def bm25_statistics(spark: SparkSession, d: str) -> DataFrame:
    terms = search.query_terms(WORDS)
    statistics = search.library_statistics(search.counted(C.chunks(spark, d), terms), terms)
    return search.term_statistics(statistics, terms).withColumn("mean_length", F.round("mean_length", 6))


def search_index_boost(spark: SparkSession, d: str) -> DataFrame:
    request = search.Search("the thent ention", k=3)
    found = search.ranked(C.chunks(spark, d), C.ready(spark, d), request, C.index_terms(spark, d), _facts(True))
    return found.select("doc_id", "chunk_id", "bm25", "matched_book_index", "adjusted", "doc_rank")


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return C.chunks(spark, d).select("chunk_id", T.atoms(text).alias("atoms"), T.token_estimate(text).alias("tokens"), T.query_token_estimate(text).alias("query_tokens"))


def script_share(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.round(T.script_share(F.coalesce("text", F.lit(""))), 9).alias("share"))


def _anchors(spark: SparkSession, d: str) -> DataFrame:
    return C.documents(spark, d).where("chunk_count > 3").select("doc_id", F.floor(F.col("chunk_count") / 2).cast("int").alias("anchor"))


def context_span(spark: SparkSession, d: str) -> DataFrame:
    return navigate.context_span(C.chunks(spark, d), _anchors(spark, d), 2, 3).select("doc_id", "anchor", "ordinal", "chunk_id")


def context_trim(spark: SparkSession, d: str) -> DataFrame:
    span = navigate.context_span(C.chunks(spark, d).withColumn("tokens", T.query_token_estimate(F.col("text"))), _anchors(spark, d), 10, 10)
    return navigate.trimmed(span.select("doc_id", "anchor", "ordinal", "tokens"), 120)


def section_covers(spark: SparkSession, d: str) -> DataFrame:
    wanted = C.chunks(spark, d).where("section is not null").select("doc_id", F.element_at(F.split("section", r"\."), 1).alias("reference"))
    return navigate.chunks_in_sections(C.chunks(spark, d), wanted).select("doc_id", "reference", "chunk_id")


def ordinal_gaps(spark: SparkSession, d: str) -> DataFrame:
    return grade.ordinal_gaps(C.gapped(spark, d))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return grade.findings(C.chunks(spark, d).withColumn("tokens", grade.graded_size(F.col("text"), F.col("image_count"))))


def _graded(code: str) -> Query:
    return lambda spark, d: _findings(spark, d).where(F.col("code") == code)


def verdict(spark: SparkSession, d: str) -> DataFrame:
    return grade.verdicts(_findings(spark, d), C.documents(spark, d))


def grade_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return grade.repeated_lines(C.footed(spark, d)).drop("chunks")


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return access.user_roles(C.grants(spark, d), C.group_grants(spark, d), C.group_members(spark, d))


def readable_libraries(spark: SparkSession, d: str) -> DataFrame:
    return access.readable_libraries(C.libraries(spark, d), _roles(spark, d))


def waiting_queues(spark: SparkSession, d: str) -> DataFrame:
    editors = access.holders(_roles(spark, d), C.libraries(spark, d), "editor")
    return jobs.waiting_queues(C.jobs(spark, d), editors, F.expr(C.NOW))


def unclaimable_jobs(spark: SparkSession, d: str) -> DataFrame:
    editors = access.holders(_roles(spark, d), C.libraries(spark, d), "editor")
    return jobs.unclaimable(C.jobs(spark, d), editors, F.expr(C.NOW))


def resolved_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every customer asks for a document of their own and for one of a library by its label."""
    asked = C.table(spark, d, "customer").join(C.libraries(spark, d).select("library_id", "slug"), F.col("library_id") == F.col("c_nationkey"))
    ids = F.explode(F.array(F.concat(F.lit("d"), "c_custkey"), F.concat(F.coalesce("slug", F.col("library_id").cast("string")), F.lit("/a/"), "c_custkey"), F.concat(F.lit("personal/"), "c_custkey")))
    return access.resolved(asked.select(F.col("c_custkey").alias("user_id"), ids.alias("asked")), access.readable_libraries(C.libraries(spark, d), _roles(spark, d)))


def display_text(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return C.table(spark, d, "documents").where("doc_id is not null").select(
        "doc_id",
        F.sha2(T.normal_title(text).cast("binary"), 256).alias("title_sha256"),
        T.truncated(text, 60).alias("head"),
        T.thousands(F.length(text) * 1000).alias("shown"),
        T.percent((F.col("doc_id") % 201) / 200).alias("share"),
    )


def round_three(spark: SparkSession, d: str) -> DataFrame:
    """Ties of the binary value (sixteenths), ties of the decimal text only, and others."""
    x = "CAST(l_orderkey AS DOUBLE) / 16 AS a", "(CAST(l_orderkey AS DOUBLE) * 10 + 5) / 10000 AS b", "CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS c"
    rows = C.table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *x)
    return rows.select("l_orderkey", "l_linenumber", *[T.round3(F.col(c)).alias(c) for c in "abc"])


def audit_listing(spark: SparkSession, d: str) -> DataFrame:
    return access.audit_listing(C.audit_events(spark, d), C.users(spark, d)).drop("at")


def members_listing(spark: SparkSession, d: str) -> DataFrame:
    invited = C.group_grants(spark, d).selectExpr("library_id", "group_id AS user_id", "role").distinct()
    return access.members(C.grants(spark, d), invited, C.users(spark, d))


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.range(25).selectExpr("id AS group_id", "concat('g', id) AS slug")
    return access.group_sizes(groups, C.group_members(spark, d))


def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    shown = C.table(spark, d, "orders").selectExpr("concat('src-', o_orderkey % 40, '-', o_orderkey % 50) AS source", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(o_orderkey % 25 AS INT)) AS modified").groupBy("source").agg(F.max("modified").alias("modified")).where("length(source) % 2 = 0")
    all_jobs = C.jobs(spark, d)
    held = all_jobs.where("status = 'done'").groupBy("source").agg(F.max("updated_at").alias("ingested_at"))
    latest = all_jobs.groupBy("source").agg(F.max_by(F.struct("status", "updated_at"), F.struct("created_at", "id")).alias("j")).select("source", "j.*")
    return jobs.sync_plan(shown, held, latest)


def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "pages").select("page_id", crawl.normal_url(F.col("url")).alias("normal"))


def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    pages = C.table(spark, d, "pages").select(crawl.normal_url(F.col("url")).alias("url"), F.col("page_id").alias("place"))
    return crawl.coverage_union([pages.where("place % 3 = 0"), pages.where("place % 2 = 0"), pages])


def site_chrome(spark: SparkSession, d: str) -> DataFrame:
    """Every page has a menu of two blocks beside its own."""
    menu = F.array(F.lit(" All  Pages"), F.concat(F.lit("Over "), F.regexp_extract("url", "^[a-z]+", 0)))
    blocks = C.table(spark, d, "pages").select(F.lit("site").alias("library_id"), "url", F.explode(F.concat(F.regexp_extract_all("html", F.lit(r"<(?:a|div)[^>]*>([^<]+)</"), 1), menu)).alias("text"))
    return crawl.chrome(blocks)


def soft404_resemblance(spark: SparkSession, d: str) -> DataFrame:
    """Every item is a probe page, held against every document."""
    items = C.table(spark, d, "benchmark").where("item_id is not null")
    texts = C.table(spark, d, "documents").where("doc_id is not null and text is not null").select(F.col("doc_id").alias("key"), "text")
    probes = items.select(F.col("item_id").alias("key"), "text")
    return crawl.text_resemblance(texts, probes).select(F.col("a_key").alias("doc_id"), F.col("b_key").alias("item_id"), "shared", "resembles")


def digest_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The holder (least id) and the copies of each text."""
    held = C.table(spark, d, "documents").where("text is not null").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    return held.agg(F.min("doc_id").alias("holder"), F.count("*").alias("copies"))


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Queries are labels; a document stands at rank doc_id mod 30, and is missed beyond 20."""
    rank = F.when(F.col("doc_id") % 30 < 20, F.col("doc_id") % 30 + 1)
    hits = C.table(spark, d, "labels").where("doc_id is not null").select((F.col("doc_id") % 7).alias("doc_id"), F.concat(F.lit("c"), "quality").alias("category"), (F.col("toxic") == 1).alias("blind"), rank.alias("rank"))
    return evaluate.recall(hits)


def self_label(spark: SparkSession, d: str) -> DataFrame:
    sample = navigate.stride_sample(C.chunks(spark, d), 9)
    return sample.select("chunk_id", "place", evaluate.self_query(F.col("heading_path"), F.col("text")).alias("query"))


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    from docloom.sources.plain import text_blocks as blocks

    return blocks(C.table(spark, d, "documents").where("doc_id is not null").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))), "doc_id").select("doc_id", "block_no", "offset", F.length("text").cast("long").alias("chars"))


def verify(spark: SparkSession, d: str) -> DataFrame:
    return reports.verify(C.documents(spark, d), C.sized(spark, d), C.index_terms(spark, d))


def grouped_results(spark: SparkSession, d: str) -> DataFrame:
    return reports.grouped_results(search.search(C.chunks(spark, d), C.ready(spark, d), search.Search(WORDS, k=40), facts=_facts()))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every page. No SQL: DuckDB reads no HTML; the tests hold the reader against written-out pages."""
    from docloom.sources.extract import block_rows, from_html

    rows = block_rows(from_html(C.table(spark, d, "pages"), ["page_id"]), ["page_id"])
    return rows.select("page_id", "block_no", F.array_join("heading_path", T.PATH_SEP).alias("heading_path"), "offset", "text")


def chunks_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every page. No SQL: the rules feed each merge into the next; the tests hold them against examples."""
    from docloom.operators.chunking import chunk_documents
    from docloom.sources.extract import block_rows, from_html

    blocks = block_rows(from_html(C.table(spark, d, "pages"), ["page_id"]), ["page_id"])
    return chunk_documents(blocks.withColumn("section", F.lit(None).cast("string")), "page_id")


def classify_kinds(spark: SparkSession, d: str) -> DataFrame:
    from docloom.operators.chunking import classify_kinds as classified

    return classified(C.chunks(spark, d)).select("chunk_id", "kind")


def block_groups(spark: SparkSession, d: str) -> DataFrame:
    from docloom.operators.chunking import islands

    return islands(C.chunks(spark, d), "doc_id", "ordinal", ["section", "heading_path"]).groupBy("doc_id", "unit").agg(F.min("ordinal").alias("first"), F.count("*").alias("blocks"))


def library_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = access.library_lists(C.users(spark, d), _roles(spark, d), C.libraries(spark, d), "editor")
    return lists.select("user_id", F.array_join(F.transform("libraries", lambda x: x.cast("string")), ",").alias("libraries"))


def job_notes(spark: SparkSession, d: str) -> DataFrame:
    return C.jobs(spark, d).select("id", jobs.progress(F.col("cur"), F.col("total")).alias("progress"), jobs.disposition(F.col("status"), F.col("id") % 3 == 0).alias("disposition"))


def queries() -> dict[str, Query]:
    chunks, documents, sized, all_jobs, now = C.chunks, C.documents, C.sized, C.jobs, F.expr
    return {
        "bm25_topk": _searched(search.Search(WORDS, k=10)),
        "bm25_pool": bm25_pool,
        "bm25_interleave": bm25_interleave,
        "bm25_per_library": bm25_statistics,
        "search_section_filter": _searched(search.Search(WORDS, k=20, section_filter="src8")),
        "search_one_document": _searched(search.Search(WORDS, k=10, doc_id=1)),
        "search_libraries": _searched(search.Search(WORDS, k=10, libraries=("de", "none"))),
        "read_passages": lambda s, d: navigate.passages(chunks(s, d), 2, 500).select("doc_id", "chunk_id"),
        "best_overlap": lambda s, d: evaluate.best_overlap(chunks(s, d), search.query_terms(WORDS)),
        "library_lists": library_lists,
        "job_notes": job_notes,
        "search_index_boost": search_index_boost,
        "search_keyword_penalty": _searched(search.Search(WORDS, k=25)),
        "search_keyword_included": _searched(search.Search(WORDS, k=25, include_keyword_reference=True)),
        "token_estimate": token_estimate,
        "script_share": script_share,
        "outline": lambda s, d: navigate.outline(chunks(s, d)),
        "context_span": context_span,
        "context_trim": context_trim,
        "top_headings": lambda s, d: navigate.top_headings(chunks(s, d)).select("doc_id", "heading", "place"),
        "stride_sample": lambda s, d: navigate.stride_sample(chunks(s, d), 7).select("doc_id", "chunk_id", "place"),
        "section_covers": section_covers,
        "unjoinable_sections": lambda s, d: navigate.unjoinable_sections(C.index_terms(s, d), chunks(s, d)),
        "page_range": lambda s, d: navigate.pages_in(chunks(s, d).select("doc_id", "chunk_id", F.col("page_start").alias("page")), 2, 30),
        "token_spread": lambda s, d: grade.token_spread(sized(s, d)),
        "extremes": lambda s, d: grade.extremes(sized(s, d)),
        "ordinal_gaps": ordinal_gaps,
        "scattered_sections": lambda s, d: grade.scattered_sections(chunks(s, d)),
        "uncovered_pages": lambda s, d: grade.uncovered_pages(chunks(s, d), documents(s, d)),
        "measures": lambda s, d: grade.measures(chunks(s, d), documents(s, d)),
        "section_counts": lambda s, d: grade.section_counts(chunks(s, d)),
        "grade_oversized": lambda s, d: grade.findings(C.enlarged(s, d)).where("code = 'oversized'"),
        "grade_fragmented": _graded("fragmented"),
        "grade_flat": _graded("flat_hierarchy"),
        "grade_figure": _graded("figure_dominated"),
        "grade_unaddressable": _graded("unaddressable"),
        "grade_boilerplate": grade_boilerplate,
        "verdict": verdict,
        "classify_kinds": classify_kinds,
        "block_groups": block_groups,
        "readable_libraries": readable_libraries,
        "waiting_queues": waiting_queues,
        "audit_listing": audit_listing,
        "members_listing": members_listing,
        "group_sizes": group_sizes,
        "last_admin": lambda s, d: access.last_admin_blocked(C.owned_grants(s, d)),
        "deleted_libraries": lambda s, d: access.deleted_libraries(C.libraries(s, d), C.grants(s, d), C.users(s, d), now(C.NOW)),
        "purged_jobs": lambda s, d: access.purged(all_jobs(s, d), C.libraries(s, d), now(C.NOW)).select("id", "library_id"),
        "resolved_ids": resolved_ids,
        "active_jobs": lambda s, d: jobs.active(all_jobs(s, d)).select("id", "library_id", "status"),
        "recent_jobs": lambda s, d: jobs.recent(all_jobs(s, d)).select("id", "status"),
        "unclaimable_jobs": unclaimable_jobs,
        "heading_contains": lambda s, d: navigate.heading_contains(chunks(s, d), "gLossary > TERM 1").select("doc_id", "chunk_id"),
        "doc_prefix": lambda s, d: navigate.with_prefix(documents(s, d), "title", "src1/1").select("doc_id", "title", "status"),
        "display_text": display_text,
        "round_three": round_three,
        "claim_order": lambda s, d: jobs.claim_order(all_jobs(s, d), now(C.NOW)),
        "queue_position": lambda s, d: jobs.positions(all_jobs(s, d)),
        "swept_jobs": lambda s, d: jobs.swept(all_jobs(s, d), now(C.NOW)),
        "job_status": lambda s, d: jobs.status_view(all_jobs(s, d), now(C.NOW)),
        "latest_job": lambda s, d: jobs.latest_by_source(all_jobs(s, d)),
        "sync_plan": sync_plan,
        "coverage_union": coverage_union,
        "site_chrome": site_chrome,
        "soft404_resemblance": soft404_resemblance,
        "url_normalise": url_normalise,
        "digest_dedup": digest_dedup,
        "text_blocks": text_blocks,
        "list_documents": lambda s, d: reports.list_documents(documents(s, d), chunks(s, d)),
        "verify": verify,
        "grouped_results": grouped_results,
        "html_blocks": html_blocks,
        "chunks": chunks_of_pages,
        "recall_at_k": recall_at_k,
        "self_label": self_label,
        "index_share": lambda s, d: evaluate.index_share(chunks(s, d)),
    }
