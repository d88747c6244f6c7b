"""Steps whose work or traffic outgrew the input: what their plans hold, and the same rows as the plain forms."""

import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import chunkrules, text
from docloom.operators import chunking, crawl, grade, search
from docloom.plans import queries


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("probe_words, cells", [(crawl.PROBE_WORDS, crawl.CELLS), (3, 4)])
def test_resemblance_shuffles_texts_once_and_no_pairs(spark, monkeypatch, probe_words, cells):
    monkeypatch.setattr(crawl, "PROBE_WORDS", probe_words)
    monkeypatch.setattr(crawl, "CELLS", cells)
    rows = [(n % 7, f"Page not found {n} ünder page page") for n in range(30)] + [(7, None), (None, "page"), (8, ""), (9, "𝐚lpha"), (10, "nothing")]
    texts = spark.createDataFrame(rows, "key long, text string")
    probes = spark.createDataFrame([("a", "page PAGE not"), ("b", "ünder 3"), ("b", "found found"), ("c", None), (None, "page"), ("d", "𝐚lpha"), ("e", "absent")], "key string, text string")
    whole = lambda x: crawl.bags(x.where("key is not null and text is not null"), "key")
    want = sorted(map(tuple, crawl.resemblance(whole(texts), whole(probes)).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a key's rows go over batches
    try:
        found = crawl.text_resemblance(texts, probes)
        assert sorted(map(tuple, found.collect())) == want and len(want) == 15
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_soft404_plan_has_one_exchange(spark, tmp_path):
    spark.createDataFrame([(7, "page not found")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "not")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert plan(queries.queries()["soft404_resemblance"](spark, str(tmp_path))).count("Exchange ") == 1


#: Queries by words, and how often their plans cut chunks into words: for the statistics, and for the scores.
SEARCHES = ["search_index_boost", "search_keyword_included", "bm25_interleave", "bm25_topk", "search_keyword_penalty", "grouped_results"]


def write_documents(spark, path):
    rows = [(n, None if n % 5 == 4 else "The license of Version. the THE thention license\nother lines of it. version thent. " * (n % 4), ["de", None, "en"][n % 3], f"src{n % 3}") for n in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("name", SEARCHES)
def test_chunks_are_cut_into_words_twice(spark, tmp_path, name):
    write_documents(spark, tmp_path)
    found = queries.queries()[name](spark, str(tmp_path))
    assert found.count() > 0
    assert plan(found).split("Initial Plan")[0].count("regexp_extract_all(") == 2


@pytest.mark.parametrize("name", [*SEARCHES, "bm25_pool"])
def test_chunks_are_cut_into_words_once_when_run(spark, tmp_path, name):
    write_documents(spark, tmp_path)
    found = queries.queries()[name](spark, str(tmp_path))
    assert len(found.collect()) > 0
    final = plan(found).split("Initial Plan")[0]
    # the scores take the statistics' shuffle, so the second cut of the plan is not run
    assert "ReusedExchange" in final and final.count("regexp_extract_all(") == 1
    # index terms are made of the documents' pieces too
    assert final.count("split(replace(text") == (2 if name == "search_index_boost" else 1)


@pytest.mark.parametrize("name", ["search_keyword_penalty", "grouped_results"])
def test_scores_are_not_shuffled_by_library(spark, tmp_path, name):
    write_documents(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(queries.queries()[name](spark, str(tmp_path))).split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [lines[n + 1] for n, line in enumerate(lines) if re.search(r"hashpartitioning\(library_id#\d+, \d", line)]
    # a library's statistics and the ready documents are, but no rows of chunks
    assert len(below) == 2 and not any("chunk_id#" in line for line in below)


def test_statistics_and_scores_share_rows_with_nulls_and_copies(spark):
    said = [("a", 1, 1, "x > the", "the the cat"), ("a", 1, 1, "x > the", "the the cat"), ("a", 2, 2, None, None), (None, 3, 3, "", "the"), ("b", 4, 4, "cats", "then"), ("a", None, 5, "", "of the"), ("b", 4, None, "", "of")]
    rows = spark.createDataFrame([(*s, n, "prose", None) for n, s in enumerate(said)], "library_id string, doc_id long, chunk_id long, heading_path string, text string, ordinal int, kind string, section string")
    terms = ["the", "of"]
    every, held = search.by_document(search.counted(rows, terms), terms)
    assert {r.library_id: tuple(r)[1:] for r in search.library_statistics(every, terms).collect()} == {r.library_id: tuple(r)[1:] for r in search.library_statistics(search.counted(rows, terms), terms).collect()}
    want = search.counted(rows, terms, holding=True).drop("held")
    assert sorted(map(repr, held.select(want.columns).collect())) == sorted(map(repr, want.collect())) and held.count() == 5
    scores = search.bm25(rows, terms)
    assert {"ordinal", "section", "heading_path", "kind", "bm25"} <= set(scores.columns) and scores.count() == 4
    ready = spark.createDataFrame([("a", 1), ("a", 1), ("b", 9)], "library_id string, doc_id long")
    assert sorted(map(tuple, search.bm25(rows, terms, ready).select("chunk_id", "bm25").collect())) == sorted(map(tuple, scores.where("doc_id = 1").select("chunk_id", "bm25").collect()))


@pytest.mark.parametrize("name", SEARCHES[1:6])
def test_headings_are_cut_once_and_chunks_without_a_term_are_not(spark, tmp_path, name):
    write_documents(spark, tmp_path)
    held = plan(queries.queries()[name](spark, str(tmp_path)))
    assert "Contains(_text" in held and "concat_ws( , " not in held


def test_counts_are_those_of_the_heading_twice_and_the_text(spark):
    said = [("The Σ of ΑΣ", "of the, THE_the ΑΣ"), (None, "thé of"), ("of", None), (None, None), ("", "often"), ("a > of > 日本", "日本 \U00020000 of२ İ"), ("often", "the\x01the")]
    rows = spark.createDataFrame([("a", n % 3, n, *s, "prose") for n, s in enumerate(said)], "library_id string, doc_id long, chunk_id long, heading_path string, text string, kind string")
    terms = ["the", "of", "ας", "日本", "i̇"]
    words = text.words(F.concat_ws(" ", "heading_path", "heading_path", "text"))
    times = lambda t: F.size(F.filter(words, lambda w: w == t))
    want = rows.select("chunk_id", F.size(words).cast("long").alias("length"), F.array(*map(times, terms)).alias("tf")).orderBy("chunk_id")
    assert search.counted(rows, terms).select("chunk_id", "length", "tf").orderBy("chunk_id").collect() == want.collect()
    held = search.counted(rows, terms, holding=True).where(F.array_max("tf") > 0).select("chunk_id", "length", "tf").orderBy("chunk_id")
    assert held.collect() == want.where(F.array_max("tf") > 0).collect()


#: Searches held to counting words in one string, and to making a document's pieces once a pass.
IN_PLACE = ["bm25_interleave", "bm25_topk", "search_keyword_penalty", "grouped_results"]


@pytest.mark.parametrize("name", IN_PLACE)
def test_words_are_counted_in_one_string(spark, tmp_path, name):
    write_documents(spark, tmp_path)
    held = plan(queries.queries()[name](spark, str(tmp_path)))
    assert "array_remove(_words" not in held and "array_max(" not in held and "Contains(_wide" in held


@pytest.mark.parametrize("name", IN_PLACE)
def test_documents_are_split_once_a_pass(spark, tmp_path, name):
    write_documents(spark, tmp_path)
    # a pass for the statistics and one for the scores; filters do not split the text again
    assert plan(queries.queries()[name](spark, str(tmp_path))).count("split(replace(text") == 2


def test_counts_by_spaces_are_those_of_words(spark):
    said = [("the the", "the the the"), ("", "the"), ("the", ""), ("", ""), ("--", " -- "), ("a  the", "the, the. (the) the_ the-the"), ("x > the > y", " the\tthe\u00a0the "), ("the\n", "then the."), (None, "\U00020000the \U00020000 the\u0307")]
    rows = spark.createDataFrame([("a", 1, n, *s) for n, s in enumerate(said)], "library_id string, doc_id long, chunk_id long, heading_path string, text string")
    terms = ["the", "a", "\U00020000"]
    want = []
    for n, (heading, body) in enumerate(said):
        found = [re.findall(r"[^\W]+", s.lower()) for s in (heading or "", heading or "", body)]
        flat = [w for part in found for w in part]
        want.append((n, len(flat), [flat.count(t) for t in terms]))
    assert [tuple(r) for r in search.counted(rows, terms).select("chunk_id", "length", "tf").orderBy("chunk_id").collect()] == want
    hits = search.counted(rows, terms, holding=True).select("chunk_id", "length", "tf").orderBy("chunk_id").collect()
    assert [tuple(r) for r in hits] == [w for w in want if any(w[2])]


def test_boost_marks_rows_under_a_section_and_makes_them_once(spark):
    rows = [("a", 1, 1, "2.1"), ("a", 1, 2, "2.10"), ("a", 1, 3, "2"), ("a", 1, 4, None), ("a", 1, 5, ""), ("b", 1, 6, "2.1"), ("a", 1, 7, "2.1.4"), (None, 2, 8, "1")]
    found = spark.createDataFrame(rows, "library_id string, doc_id long, chunk_id long, section string")
    wanted = spark.createDataFrame([("a", 1, "2.1"), ("a", 1, "2.1"), ("a", 1, ""), ("a", 1, None), (None, 2, "1"), ("a", 3, "2")], "library_id string, doc_id long, section string")
    marked = search.boosted(found, wanted)
    assert {r.chunk_id for r in marked.where("matched_book_index").collect()} == {1, 7} and marked.count() == 8
    assert marked.columns == [*found.columns, "matched_book_index"]


def test_chunks_are_cut_in_a_stream_of_documents(spark, monkeypatch):
    rows = [(n % 9 if n % 9 else None, n // 9, f"block {n} " * (1 + 90 * (n % 4)), ["Part"], None) for n in range(90)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_no int, text string, heading_path array<string>, section string")
    want = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        found = chunkrules.chunk_rows([dict(zip(blocks.columns, r, strict=True)) for r in mine])
        want += [repr((key, *r.values())) for r in found]
    monkeypatch.setattr(chunking, "BATCH_CHARS", 3000)
    cut = chunking.chunk_documents(blocks)
    assert sorted(repr(tuple(r)) for r in cut.collect()) == sorted(want) and len(want) > 9
    assert cut.columns[:2] == ["doc_id", "ordinal"] and "FlatMapGroups" not in plan(cut)
    assert chunking.chunk_documents(blocks.where("false")).count() == 0


def test_verify_reads_texts_for_sizes_lines_and_terms_only(spark, tmp_path):
    write_documents(spark, tmp_path)
    found = queries.queries()["verify"](spark, str(tmp_path))
    assert found.count() == 20
    # texts are split into chunks for the lines and the index terms; sizes and positions come from the written table
    assert plan(found).count("posexplode(") == 2 and "/chunks-" in plan(found)


def test_verdict_cuts_chunks_twice(spark, tmp_path):
    write_documents(spark, tmp_path)
    assert plan(queries.queries()["verdict"](spark, str(tmp_path))).count("posexplode(") == 2


def test_verdict_leaves_short_chunks_without_images_uncut(spark, tmp_path):
    write_documents(spark, tmp_path)
    assert "floor((cast(char_length(" in plan(queries.queries()["verdict"](spark, str(tmp_path))).lower()


def test_graded_sizes_pass_the_same_thresholds(spark):
    texts = ["", None, "日" * 76, "日" * 77, "日" * 101, "!" * 76, "!" * 77, "word " * 20, "! " * 39, "!" * 30, "!" * 31, "!" * 923, "!" * 924, "ab " * 924, "𠀀!" * 50]
    rows = spark.createDataFrame([(t, n) for t in texts for n in (0, 1)], "text string, images int")
    sides = lambda size: F.struct(size > grade.MAX_TOKENS, size < grade.MIN_TOKENS, (F.col("images") > 0) & (size < grade.FIGURE_TOKENS))
    got = rows.select("text", "images", sides(grade.graded_size(F.col("text"), F.col("images"))).alias("a"), sides(text.token_estimate(F.col("text"))).alias("b"))
    assert got.where("NOT a <=> b").count() == 0


def test_lines_and_sizes_keep_their_rules(spark):
    lines = ["  spaced out line of words 12 ", "\xa0no-break space at both ends\xa0", "tab\there and  two spaces 4711", "ünïcode façade çà et là 日本語 ok", "wide 日本 ok", "plain ascii, signs!", "", None, "é日", "a " + "b" * 30]
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    space, key, size = r"^[\s\x{a0}]+|[\s\x{a0}]+$", lambda c: F.regexp_replace(F.regexp_replace(c, r"[\t\n\f\r ]+", " "), "[0-9]+", "#"), F.regexp_count("line", F.lit(text.WIDE))
    atoms = (F.size(F.regexp_extract_all(F.regexp_replace("line", text.WIDE, " "), F.lit(text.ATOM), 0)) + F.rint(size / 1.3)).cast("long")
    line = F.col("line")
    got = rows.select(text.bare(line), text.line_key(line), text.atoms(line)).collect()
    assert got == rows.select(F.regexp_replace(line, space, ""), key(line), atoms).collect()


def test_repeated_lines_count_chunks_once_and_skip_nulls(spark):
    line = "the same line on each page 12"
    rows = [(1, n, f"{line}\n  {line}\r\nshort") for n in range(9)] + [(1, n, "x") for n in range(9, 30)] + [(1, 0, line), (1, 31, None), (2, 0, line)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, text string")
    assert [tuple(r) for r in grade.repeated_lines(chunks).collect()] == [(1, "the same line on each page #", 9, 32)]
