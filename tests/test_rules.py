"""Rules that the driver's tables do not reach: wide scripts, merges, stubs, budgets, URLs, scopes."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.chunkrules import atoms, chunk_rows, tokens
from docloom.operators import access, chunking, crawl, grade, jobs, navigate, search


def block(text, path=(), section=None, **more):
    return {"text": text, "heading_path": list(path), "section": section, **more}


def test_estimates_agree_between_engine_and_kernel(spark):
    texts = ["", "one two, three!", "漢字かな交じり文", "한국어 text", "a漢b", "x_1 y-2 … — 42", "   tab\tnew\nline", "カタカナ。、ｶﾅ"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(T.atoms(F.col("text")).alias("a"), T.token_estimate(F.col("text")).alias("t")).collect()
    assert [r.a for r in got] == [atoms(t) for t in texts]
    assert [r.t for r in got] == [tokens(atoms(t)) for t in texts]
    assert atoms("漢字漢") == 2 and atoms("漢" * 13) == 10


def test_small_units_merge_by_parent():
    three = chunk_rows([block("one", ("A", "x")), block("two", ("A", "y")), block("three", ("A", "z"))])
    # the first merge moves to A, whose parent is no longer A, so the third stands alone
    assert [(c["heading_path"], c["text"]) for c in three] == [("A", "one\n\ntwo"), ("A > z", "three")]
    single = chunk_rows([block("one", ("A",)), block("two", ("B",)), block("three", ("C",))])
    assert [c["text"] for c in single] == ["one\n\ntwo\n\nthree"]
    apart = chunk_rows([block("one", ("A", "x"), "1"), block("two", ("A", "y"), "2")])
    assert len(apart) == 2


def test_stub_folds_into_its_first_subsection_and_cascades():
    long = "word " * 120
    got = chunk_rows([block("Title", ("T",), "1"), block("Sub", ("T", "S"), "1.1"), block(long, ("T", "S", "U"), "1.1.1"), block(long, ("V",), "2")])
    assert [(c["section"], c["text"].split()[:2]) for c in got] == [("1.1.1", ["Title", "Sub"]), ("2", ["word", "word"])]


def test_large_units_divide_at_subheadings_then_blocks_then_lines():
    body = "word " * 700
    got = chunk_rows([block("Alpha\n" + body, ("D",), None, subdivision=True), block("Beta\n" + body, ("D",), None, subdivision=True)])
    assert [c["heading_path"] for c in got] == ["D > Alpha", "D > Beta"]
    lines = "\n".join(["word " * 100] * 30)
    got = chunk_rows([block(lines, ("D",))])
    assert len(got) == 4 and all(tokens(atoms(c["text"])) <= 1200 for c in got)
    assert sum(c["text"].count("word") for c in got) == 3000


def test_chunks_take_pages_and_images():
    got = chunk_rows([block("a", ("P",), page=3, page_end=4, image_count=1, url="u", printed_page=9), block("b", ("P",), page=2, image_count=2, printed_page=None)])
    assert (got[0]["page_start"], got[0]["page_end"], got[0]["image_count"], got[0]["url"], got[0]["printed_page_start"]) == (2, 4, 3, "u", 9)
    assert chunk_rows([block("  ", ("P",))]) == [] and chunk_rows([]) == []


def test_chunk_documents_runs_the_kernel_for_each_document(spark):
    rows = [(1, 0, "one", ["A", "x"], None), (1, 1, "two", ["A", "y"], None), (2, 0, "solo", [], "1")]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "doc_id long, block_no int, text string, heading_path array<string>, section string")).orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.ordinal, r.text) for r in got] == [(1, 0, "one\n\ntwo"), (2, 0, "solo")]


def test_kinds_need_a_large_family_of_short_leaves(spark):
    rows = [(1, n, f"Manual > Error codes > E{n}", "") for n in range(30)] + [(1, 40, "Manual > Keywordsmith > x", "")] + [(2, n, f"M > Glossary > t{n}", "") for n in range(29)]
    got = chunking.classify_kinds(spark.createDataFrame(rows, "doc_id long, chunk_id long, heading_path string, text string")).groupBy("doc_id", "kind").count().collect()
    assert {(r.doc_id, r.kind): r["count"] for r in got} == {(1, "keyword-reference"): 30, (1, "prose"): 1, (2, "prose"): 29}


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTP://User@Ex.COM:80/a/../b/./c?x=1#f", "http://ex.com/b/c?x=1"),
        ("https://ex.com:443", "https://ex.com/"),
        ("https://ex.com/a/b/..", "https://ex.com/a/"),
        ("https://ex.com/../../a/", "https://ex.com/a/"),
        ("https://ex.com:8443/a//b", "https://ex.com:8443/a//b"),
        ("not a url", None),
    ],
)
def test_normal_url(spark, raw, want):
    assert spark.range(1).select(crawl.normal_url(F.lit(raw))).first()[0] == want


def test_walk_is_bounded_and_breadth_first(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"), ("c", "a")], "source string, target string")
    got = {r.url: r.depth for r in crawl.walk(spark.createDataFrame([("a",)], "url string"), links).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}


def test_chrome_needs_half_of_at_least_five_pages(spark):
    rows = [("s", f"u{n}", "Home  page") for n in range(4)] + [("s", f"u{n}", f"body {n}") for n in range(8)] + [("s", f"u{n}", "HOME page") for n in range(4, 6)]
    blocks = spark.createDataFrame(rows, "library_id string, url string, text string")
    assert [(r.block_key, r.pages) for r in crawl.chrome(blocks).collect()] == [("home page", 6)]
    assert crawl.without_chrome(blocks).count() == 8


def test_url_tree_numbers_siblings_by_first_sight(spark):
    pages = [("h", "http://h/a/x", 2), ("h", "http://h/b", 1), ("h", "http://h/a/y", 3), ("h", "http://h/a", 4)]
    got = {r.url[9:]: r.section for r in crawl.url_tree(spark.createDataFrame(pages, "host string, url string, place long")).collect()}
    assert got == {"b": "1", "a": "2", "a/x": "2.1", "a/y": "2.2"}


def test_query_terms_and_defaults():
    assert search.query_terms("The the, License_2!") == ["the", "license_2"]
    with pytest.raises(ValueError):
        search.query_terms(" -- ")
    assert search.Search("x", k=0).depth == 8 and search.Search("x", k=999).depth == 200


def test_heading_counts_twice_and_statistics_span_the_library(spark):
    rows = [("l", 1, 10, 0, None, "apple", "pear", "prose"), ("l", 1, 11, 1, None, "plum", "apple pear", "prose"), ("l", 2, 20, 0, None, "fig", "date", "prose"), ("m", 3, 30, 0, None, "apple", "apple", "prose")]
    chunks = spark.createDataFrame(rows, "library_id string, doc_id long, chunk_id long, ordinal int, section string, heading_path string, text string, kind string")
    scores = {r.chunk_id: r.bm25 for r in search.bm25(chunks, ["apple"]).collect()}
    assert scores[10] < scores[11] < 0 and set(scores) == {10, 11, 30}
    stats = {r.library_id: (r.df) for r in search.term_statistics(search.library_statistics(search.counted(chunks, ["apple"]), ["apple"]), ["apple"]).collect()}
    assert stats == {"l": 2, "m": 1}


def test_interleave_goes_rank_by_rank(spark):
    rows = [("l", 1, 1, -9.0), ("l", 1, 2, -8.0), ("l", 2, 1, -3.0)]
    got = search.interleaved(spark.createDataFrame(rows, "library_id string, doc_id long, doc_rank int, adjusted double"), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.doc_rank) for r in got] == [(1, 1), (2, 1), (1, 2)]


def test_trim_keeps_the_anchor_and_drops_the_front_first(spark):
    rows = [(1, 2, n, t) for n, t in enumerate([50, 50, 100, 40, 40])]
    df = spark.createDataFrame(rows, "doc_id long, anchor int, ordinal int, tokens long")
    assert sorted(r.ordinal for r in navigate.trimmed(df, 230).collect()) == [1, 2, 3, 4]
    assert sorted(r.ordinal for r in navigate.trimmed(df, 150).collect()) == [2, 3]
    assert sorted(r.ordinal for r in navigate.trimmed(df, 10).collect()) == [2]


def test_sections_cover_by_dot_and_never_when_empty(spark):
    rows = [("2", "2.1", True), ("2", "2", True), ("2", "21", False), ("", "2", False), ("2", None, False), ("2.1", "2", False)]
    got = spark.createDataFrame(rows, "r string, s string, want boolean").select(T.section_covers(F.col("r"), F.col("s")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_under_25_chunks_nothing_is_found_and_no_chunks_is_unusable(spark):
    chunks = spark.createDataFrame([(1, n, n, None, "", "x", 5000, 0) for n in range(24)], "doc_id long, chunk_id long, ordinal int, section string, heading_path string, text string, tokens long, image_count int")
    docs = spark.createDataFrame([(1, 24), (2, 0)], "doc_id long, chunk_count long")
    got = {r.doc_id: r.verdict for r in grade.verdicts(grade.findings(chunks), docs).collect()}
    assert got == {1: "good", 2: "unusable"}


def test_oversized_flat_and_repeated_lines_are_found(spark):
    line = "Copyright page 1 of the manual"
    rows = [(1, n, n, None, "", line.replace("1", str(n)), 5000 if n < 20 else 10, 0) for n in range(50)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, ordinal int, section string, heading_path string, text string, tokens long, image_count int")
    got = {r.code: r.severity for r in grade.findings(chunks).collect()}
    assert got == {"oversized": "unusable", "fragmented": "unusable", "flat_hierarchy": "degraded", "unaddressable": "unusable", "boilerplate": "degraded"}


def test_scope_needs_a_user_and_hides_deleted_libraries(spark):
    libraries = spark.createDataFrame([(1, None), (2, "2024")], "library_id int, deleted_at string")
    roles = spark.createDataFrame([(7, 1, "reader"), (7, 2, "admin")], "user_id int, library_id int, role string")
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "library_id int, x string")
    assert [r.x for r in access.scoped(table, roles, libraries, 7).collect()] == ["a"]
    assert access.scoped(table, roles, libraries, 8).count() == 0
    with pytest.raises(ValueError):
        access.scoped(table, roles, libraries, None)


def test_retry_policy(spark):
    rows = [(True, 0, "failed"), (False, 1, "queued"), (False, 3, "failed")]
    got = spark.createDataFrame(rows, "p boolean, n int, want string").select(jobs.retried(F.col("p"), F.col("n")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_soft_absent_pages_hold_what_the_probes_share(spark):
    words = "page not found sorry try the search box instead of this link"
    bag = lambda rows: crawl.bags(spark.createDataFrame(rows, "key string, text string"), "key")
    probes = bag([("p1", words + " alpha"), ("p2", words + " beta")])
    got = crawl.soft_absent(bag([("gone", words + " gamma"), ("real", "a real page about the search")]), probes).collect()
    assert [(r.key, r.covers) for r in got] == [("gone", 1.0)]
