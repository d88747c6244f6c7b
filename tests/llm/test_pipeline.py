"""Each stage of the pipeline against brute force on what its predecessor kept."""

import os
import re

import pytest

from tests.llm import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages(spark):
    from docloom.llm import shared

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = shared.written(stage(spark, docs, DATA), name)
        assert docs.columns == columns
        kept[name] = rows(docs)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    first = {d for d, _ in kept["quality_classifier"]}
    assert all(d in first for d, q in quality.items() if q == 1)
    assert sum(d in first for d, q in quality.items() if q == 0) <= 0.5 * sum(q == 0 for q in quality.values())

    groups = brute.simhash(kept["quality_classifier"])
    assert [d for d, _ in kept["simhash_near_dedup"]] == sorted({c for _, c in groups.values()})

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hit = brute.contamination(kept["simhash_near_dedup"], items)
    assert min(len(t.split()) for _, t in items) >= 13  # so that every hit is by a whole window
    assert kept["benchmark_decontamination"] == [(d, t) for d, t in kept["simhash_near_dedup"] if not hit[d][1]]

    for (d, before), (e, after) in zip(kept["benchmark_decontamination"], kept["pii"], strict=True):
        assert d == e
        marks = [s.split(":") for s in brute.pii(before).split(",") if s]
        assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", after)) >= min(1, len(marks))
        assert not [s for s in brute.pii(after).split(",") if s]
        if not marks:
            assert before == after or "[" in after

    packed = corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in kept["pii"]}


def test_stages_take_nulls_repeats_and_nothing(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(50))
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, row long"
    table = [(1, text, "en", "s", 5, "x", 1), (1, text, "en", "s", 5, "x", 1), (None, "mail a@b.cd", None, None, None, None, None), (2, None, "en", "s", 0, "x", 1), (3, "", "en", "s", 0, "x", 1)]
    for name, data in (("full", table), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, d)
            assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
        got = {(r.doc_id, r.text) for r in docs.collect()}
        assert got == ({(1, text), (None, "mail [EMAIL]"), (2, None)} if data else set())
        assert corpus_pipeline.run(spark, d).count() == len(got)


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    """Columns that stages might use themselves come through every stage unchanged; so do rows that differ in them only."""
    text = " ".join(f"word{k}" for k in range(50))
    names = ["_id", "_hash", "_quality", "_text_hash", "_bad", "_kept", "_spans", "_key", "_other", "key", "root", "row", "base", "kept", "hash", "id", "label", "k", "score"]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    table = [(d, t, *(f"{n}{k}" for n in names)) for k, (d, t) in enumerate([(1, text), (2, text + " more"), (3, f"a@b.cd {text[60:]}"), (1, text)])]
    d = str(tmp_path)
    spark.createDataFrame([(1, "none of these words at all but others " * 3)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(table, schema).write.parquet(f"{d}/documents.parquet")
    whole = spark.read.parquet(f"{d}/documents.parquet")
    rows = {tuple(r)[2:] for r in whole.collect()}
    groups = len({c for _, c in brute.simhash([r[:2] for r in table]).values()})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, whole, d)
        assert out.columns == whole.columns
        got = [tuple(r)[2:] for r in out.collect()]
        assert len(got) == len(set(got)) == (groups if name == "simhash_near_dedup" else 4) and set(got) <= rows, name
    once, again = (sorted(tuple(r) for r in corpus_pipeline.near_dedup(spark, whole.repartition(n), d).collect()) for n in (1, 3))
    assert once == again
    assert corpus_pipeline.STAGES[4][1](spark, whole, d).count() == 4
