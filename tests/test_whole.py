"""Queries over whole tables, on small tables that hold the cases they look for."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import access, crawl, navigate, search
from docloom.plans import corpus, queries


def test_every_admin_counts(spark, tmp_path):
    # a c_custkey of 2 modulo 3 is an admin: library 1 has two, library 2 has 119 alone
    spark.createDataFrame([(1, 2), (1, 59), (2, 119), (2, 120), (3, 3)], "c_nationkey long, c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = [tuple(r) for r in access.last_admin_blocked(corpus.grants(spark, str(tmp_path))).collect()]
    assert got == [(2, 119)]


def test_every_item_is_a_probe(spark, tmp_path):
    spark.createDataFrame([(7, "page not found")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "not"), (5, "page not found")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.shared for r in queries.queries()["soft404_resemblance"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 5: 3}


def test_chosen_libraries(spark):
    readable = spark.createDataFrame([("personal", 3), ("peru", 1)], "label string, library_id int")
    assert access.chosen(readable, []).count() == 2
    assert [r.library_id for r in access.chosen(readable, ["peru"]).collect()] == [1]
    with pytest.raises(ValueError, match="china"):
        access.chosen(readable, ["peru", "china"])


def test_page_paths_and_site_titles(spark):
    path = spark.createDataFrame([(["Site"], ["", " The  page", "Part"], "the Page"), (["Site"], ["Part", ""], "other"), (["Site"], [""], "x"), (["Site"], ["A"], None)], "base array<string>, items array<string>, title string")
    got = [r[0] for r in path.select(crawl.page_path(F.col("base"), F.col("items"), F.col("title"))).collect()]
    assert got == [["Site", "Part"], ["Site", "Part"], ["Site"], ["Site", "A"]]
    seeds = spark.createDataFrame([(" Mine ", "T", "http://h/a"), (None, " T ", "http://h/a"), ("", " ", "http://u@h:8080/a"), (None, None, "no address")], "given string, title string, seed string")
    got = [r[0] for r in seeds.select(crawl.site_title(F.col("given"), F.col("title"), F.col("seed"))).collect()]
    assert got == ["Mine", "T", "h", "no address"]


def test_one_document_keeps_library_statistics(spark):
    rows = [("a", 1, 10, 0, None, "", "red fox", "prose"), ("a", 2, 20, 0, None, "", "red", "prose"), ("b", 3, 30, 0, None, "", "red", "prose")]
    chunks = spark.createDataFrame(rows, "library_id string, doc_id long, chunk_id long, ordinal int, section string, heading_path string, text string, kind string")
    ready = chunks.select("library_id", "doc_id")
    score = lambda **k: {r.chunk_id: r.bm25 for r in search.search(chunks, ready, search.Search("red", **k)).collect()}
    whole = score()
    assert score(doc_id=1) == {10: whole[10]} and score(libraries=("a",)) == {10: whole[10], 20: whole[20]}


@pytest.mark.parametrize("limit, kept", [(0, 40), (-1, 40), (200, 199), (201, 40), (5, 5)])
def test_read_limits(spark, limit, kept):
    chunks = spark.range(200).selectExpr("1 AS doc_id", "CAST(id AS INT) AS ordinal")
    assert navigate.passages(chunks, 1, limit).count() == kept
