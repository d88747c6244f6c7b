"""Rules over the primitives of paginated files."""

from docloom.operators import pdf


def lines(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page int, line_no int, size double, y0 double, text string")


def documents(spark, pages):
    return spark.createDataFrame([(1, pages)], "doc_id long, page_count int")


def test_fonts(spark):
    rows = [(1, p, n, 10.0, 0.0, "body text of the page") for p in range(1, 4) for n in range(5)]
    rows += [(1, p, 9, 12.0, 0.0, "Heading") for p in range(1, 7)] + [(1, 1, 10, 20.0, 0.0, "Rare"), (1, 1, 11, 10.5, 0.0, "near")]
    got = pdf.fonts(lines(spark, rows), documents(spark, 6)).first()
    assert (got.body, got.headings) == (10.0, [20.0, 12.0])


def test_furniture(spark):
    rows = [(1, p, 0, 10.0, 5.0 + p % 2, f"Manual page {p}") for p in range(1, 9)]
    rows += [(1, p, 1, 10.0, 700.0 if p < 4 else 100.0 * p, str(p)) for p in range(1, 9)] + [(1, p, 2, 10.0, 50.0, f"only {'x' * p}") for p in range(1, 9)]
    rows += [(1, 1, 3, 10.0, 50.0, "3 of 12")]
    docs = documents(spark, 8)
    assert {r.line_key for r in pdf.furniture(lines(spark, rows), docs).collect()} == {"Manual page #", "#"}
    assert pdf.without_furniture(lines(spark, rows), docs).count() == 8
    assert pdf.furniture(lines(spark, rows), documents(spark, 7)).count() == 0


def test_figures(spark):
    rows = [(1, p, 7, 900.0, 0.0) for p in range(1, 5)] + [(1, 1, 8, 900.0, 5.0), (1, 1, 8, 900.0, 2.0), (1, 2, 9, 100.0, 1.0)]
    got = pdf.figures(spark.createDataFrame(rows, "doc_id long, page int, image_id long, area double, y0 double"), documents(spark, 6)).collect()
    assert [(r.page, r.image_id, r.y0) for r in got] == [(1, 8, 2.0)]


def test_outline_numbers(spark):
    levels = [1, 2, 2, 1, 3, 2, 1]
    rows = [(1, n, level, f"t{n}", n) for n, level in enumerate(levels)]
    got = pdf.numbered_outline(spark.createDataFrame(rows, "doc_id long, entry_no int, level int, title string, page int")).orderBy("entry_no").collect()
    assert [r.section for r in got] == ["1", "1.1", "1.2", "2", "2.0.1", "2.1", "3"]


def test_contents_against_body(spark):
    contents = spark.createDataFrame([(1, "1", 1), (1, "2", 4), (1, "3", 9)], "doc_id long, section string, page int")
    headings = spark.createDataFrame([(1, 0, "1", 3), (1, 1, "2", 6), (1, 2, "2", 7), (1, 3, "9", 8)], "doc_id long, heading_no int, section string, page int")
    got = pdf.cross_validation(contents, headings).first()
    assert (got.toc_sections, got.body_sections, got.in_toc_not_in_body, got.in_body_not_in_toc, got.detected_more_than_once) == (3, 3, ["3"], ["9"], ["2"])
    assert pdf.page_offset(contents, headings).first().offset == 2


def test_index_rows(spark):
    rows = spark.createDataFrame([(1, "channel strip 2.1."), (1, "master 2. 2.1."), (1, "12"), (1, "fader, 7.7")], "doc_id long, text string")
    known = spark.createDataFrame([(1, "2"), (1, "2.1")], "doc_id long, section string")
    assert {(r.term, r.section) for r in pdf.index_entries(rows, known).collect()} == {("channel strip", "2.1"), ("master", "2"), ("master", "2.1")}
