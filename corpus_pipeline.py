"""A corpus pipeline: quality filter, near-duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of ``documents``; the last returns packed pieces. Its result has no SQL form (trained
weights, fingerprints, tokenizer ids); the tests hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import entries, packing, pii, quality, shared, simhash, winnow

ORACLE_SQL = None
#: Documents that score less are rejected.
KEEP = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from the labels that op9 may learn from.

    Null and empty texts score the bias; without labels of both kinds the score is their share (0.5 without any,
    which keeps all). Repeated rows score alike; null ids teach nothing; extra columns of any name are carried.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(shared.crc_mod("doc_id", 5) != 0)
    weights = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    (name,) = shared.fresh(docs, "_quality")
    return quality.score(docs, weights, name).where(F.col(name) >= KEEP).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group (op6: fingerprints within three bits, and what they link), the one of least id.

    Null and empty texts are one group; ids tie by text hash, null ids come last; repeated rows leave one; extra columns are carried.
    """
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of 13 benchmark words or, of shorter items, a twentieth of whose words are hit.

    Null and empty texts and null ids stay; repeated rows stay or go together; extra columns are carried.
    """
    return winnow.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; null texts stay null, all rows and columns stay."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into sequences; a null or empty text is one piece that holds the end id."""
    cut = shared.written(packing.pieces(docs, entries.tokenizer_path()), "pieces")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("pii", redact),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again as the next one's."""
    shared.bounded_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shared.written(docs, name)
    return docs
