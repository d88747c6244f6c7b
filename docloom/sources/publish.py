"""Writing chunk tables: one partition for each library, replaced a document set at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clean(chunks: DataFrame) -> DataFrame:
    """Heading paths and texts without NUL characters; other columns as they are."""
    strip = lambda c: F.translate(F.col(c), "\0", "")
    return chunks.withColumns({c: strip(c) for c in ("heading_path", "text")})


def append(chunks: DataFrame, path: str) -> None:
    clean(chunks).write.partitionBy("library_id").mode("append").parquet(path)


def replace_libraries(chunks: DataFrame, path: str) -> None:
    """Overwrites exactly the libraries that the frame holds. Rows are clustered by library first, salted by document, so a large library writes as many files as it needs."""
    spark = chunks.sparkSession
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        clean(chunks).repartition("library_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy("library_id").mode("overwrite").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read(spark: SparkSession, path: str, library_id=None) -> DataFrame:
    """A chunk table, pruned to one library where it is named."""
    table = spark.read.parquet(path)
    return table if library_id is None else table.where(F.col("library_id") == library_id)


def unchanged(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """Adds outcome to incoming documents (source, sha256): unchanged where the holder has the same bytes, replaced where the source is held with others, ingested otherwise."""
    old = held.groupBy("source").agg(F.max_by("sha256", "ingested_at").alias("_old"))
    outcome = F.when(F.col("_old") == F.col("sha256"), "unchanged").when(F.col("_old").isNotNull(), "replaced").otherwise("ingested")
    return incoming.join(old, "source", "left").withColumn("outcome", outcome).drop("_old")


def site_digest(pages: DataFrame) -> DataFrame:
    """site, digest: a hash over each page's address and the hash of its body, in the order of addresses."""
    entry = F.concat(F.col("url").cast("binary"), F.unhex(F.sha2("body", 256)))
    ordered = F.array_sort(F.collect_list(F.struct("url", entry.alias("e"))))
    return pages.groupBy("site").agg(ordered.alias("all")).select("site", F.sha2(F.aggregate("all", F.lit(b""), lambda s, x: F.concat(s, x["e"])), 256).alias("digest"))


def latest_responses(responses: DataFrame) -> DataFrame:
    """The newest stored response of each (library_id, url)."""
    rest = [c for c in responses.columns if c not in ("library_id", "url")]
    return responses.groupBy("library_id", "url").agg(F.max_by(F.struct(*rest), "fetched_at").alias("r")).select("library_id", "url", "r.*")
