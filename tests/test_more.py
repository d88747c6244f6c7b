"""Structure reports, address rules, publishing, and the queue as a table and as a stream."""

import json

from pyspark.sql import functions as F

from docloom.functions import urls
from docloom.operators import structure
from docloom.sources import publish
from docloom.streaming import jobs


def test_report_and_quality(spark):
    rows = [(1, n, n, None, "", "text") for n in range(30)] + [(2, n, n, f"{n}", f"H{n}", "text") for n in range(30)] + [(3, 0, 0, "1", "A", "x")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id long, ordinal int, section string, heading_path string, text string")
    told = [(1, "outline", 0, 0, None, None), (2, "atx_headings", 0, 0, None, None), (3, "contents", 2, 1, ["1", "2"], ["1"]), (4, "atx_headings", 0, 0, None, None)]
    diagnostics = spark.createDataFrame(told, "doc_id long, structure_source string, toc_sections int, body_sections int, in_toc_not_in_body array<string>, in_body_not_in_toc array<string>")
    got = {r.doc_id: r for r in structure.graded(structure.report(chunks, diagnostics)).collect()}
    assert {k: r.quality for k, r in got.items()} == {1: "degraded", 2: "ok", 3: "failed", 4: "ok"}
    assert set(got[1].notes) == {"undivided", "unaddressable", "mostly_headless"} and got[3].notes == ["disagrees"]
    assert json.loads(got[2].warnings)["distinct_heading_paths"] == 30
    stored = spark.createDataFrame([(got[1].warnings,), ("{bad",), (None,)], "warnings string")
    back = [(r.version, r.structure_source) for r in structure.read_back(stored).collect()]
    assert back[0] == (3, "outline") and back[1][0] is None and back[2] == (None, None)


def test_addresses():
    allowed = ["8.8.8.8", "2606:4700::1111", "::ffff:8.8.8.8", "2001:4:112::1", "2001:20::1"]
    blocked = ["127.0.0.1", "10.1.2.3", "169.254.169.254", "100.64.0.1", "::1", "fe80::1", "::ffff:10.0.0.1", "2001:db8::1", "2002::1", "64:ff9b::1", "255.255.255.255", "", "x", None, "2001::1"]
    assert all(map(urls.address_allowed, allowed)) and not any(map(urls.address_allowed, blocked))


def test_hosts_and_urls(spark):
    rows = [("example.com", True), ("example.com..", True), ("LOCALHOST", False), ("a.local", False), ("x.home.arpa.", False), ("exämple.com", False), ("", False), (None, False)]
    got = spark.createDataFrame(rows, "h string, want boolean").select(urls.host_allowed(F.col("h")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    rows = [("https://ex.com/a", True), ("HTTP://ex.com:81", True), ("ftp://ex.com", False), ("http://u@ex.com", False), ("http://localhost/x", False), (None, False)]
    got = spark.createDataFrame(rows, "u string, want boolean").select(urls.url_allowed(F.col("u")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_names(spark):
    assert [urls.slug(t) for t in ("Élan Vital: 2nd ed.", "漢字", "", None, "A--b")] == ["elan-vital-2nd-ed", "document", "document", "document", "a-b"]
    rows = [("A b", 1), ("a-B", 2), ("c", 3), ("A  B", 4)]
    got = {r.place: r.doc_id for r in urls.document_ids(spark.createDataFrame(rows, "title string, place int")).collect()}
    assert got == {1: "a-b", 2: "a-b-2", 3: "c", 4: "a-b-3"}
    row = spark.range(1).select(urls.slug_title(F.lit("/docs/get-started_now.html")).alias("t"), urls.manifest_directories(F.lit("https://h/a/b/c?x")).alias("m")).first()
    assert row.t == "Get Started Now" and row.m == ["https://h/a/b/", "https://h/a/", "https://h/"]


def test_publishing_replaces_whole_libraries_only(spark, tmp_path):
    path = str(tmp_path / "chunks")
    schema = "library_id string, doc_id long, heading_path string, text string"
    publish.append(spark.createDataFrame([("a", 1, "h", "x\0y"), ("b", 2, "", "z")], schema), path)
    publish.replace_libraries(spark.createDataFrame([("a", 3, "", "new")], schema), path)
    assert {(r.library_id, r.text) for r in publish.read(spark, path).collect()} == {("a", "new"), ("b", "z")}
    assert "PartitionFilters: [isnotnull(library_id" in publish.read(spark, path, "a")._jdf.queryExecution().toString()


def test_outcomes_and_digests(spark):
    held = spark.createDataFrame([("s1", "x", 1), ("s1", "y", 2), ("s2", "z", 1)], "source string, sha256 string, ingested_at int")
    got = {r.source: r.outcome for r in publish.unchanged(spark.createDataFrame([("s1", "y"), ("s2", "q"), ("s3", "z")], "source string, sha256 string"), held).collect()}
    assert got == {"s1": "unchanged", "s2": "replaced", "s3": "ingested"}
    import hashlib

    pages = [("s", "u2", b"two"), ("s", "u1", b"one")]
    want = hashlib.sha256(b"".join(u.encode() + hashlib.sha256(b).digest() for u, b in (("u1", b"one"), ("u2", b"two")))).hexdigest()
    assert publish.site_digest(spark.createDataFrame(pages, "site string, url string, body binary")).first().digest == want


EVENTS = [
    (1, 0.0, "enqueued", None, None), (1, 1.0, "claimed", None, None), (1, 2.0, "progress", 1, None), (1, 3.0, "done", 1, None),
    (2, 0.0, "enqueued", None, None), (2, 1.0, "claimed", None, None), (2, 400.0, "claimed", None, None), (2, 401.0, "done", 1, None),
    (3, 0.0, "enqueued", None, None), (3, 1.0, "claimed", None, None), (3, 2.0, "failed", 1, True),
    (4, 0.0, "enqueued", None, None), (4, 1.0, "cancel", None, None), (4, 2.0, "claimed", None, None),
    (5, 0.0, "enqueued", None, None), (5, 1.0, "claimed", None, None), (5, 2.0, "cancel", None, None), (5, 3.0, "failed", 1, None),
]
SCHEMA = "job_id long, at double, kind string, attempt int, permanent boolean"
WANT = {1: ("done", 1), 2: ("running", 2), 3: ("failed", 1), 4: ("cancelled", 0), 5: ("cancelled", 1)}


def test_queue_as_a_table(spark):
    got = {r.job_id: (r.status, r.attempts) for r in jobs.states(spark.createDataFrame(EVENTS, SCHEMA)).collect()}
    assert got == WANT


def test_queue_as_a_stream(spark, tmp_path):
    """Two files, so two batches: the second meets the states that the first left."""
    source, last = str(tmp_path / "events"), {}
    spark.createDataFrame(EVENTS[:9], SCHEMA).coalesce(1).write.parquet(source)
    spark.createDataFrame(EVENTS[9:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    changes = jobs.stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source))
    keep = lambda batch, _: last.update({r.job_id: (r.status, r.attempts) for r in batch.collect()})
    query = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()
    assert last == WANT
