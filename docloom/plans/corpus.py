"""The engine's tables, derived from the driver's: libraries of documents cut into chunks, grants, jobs, pages.

A library is a language, a document is a row of ``documents``, a chunk a line or sentence of it. Positions
come with the split itself, so no window and no shuffle makes the chunk table. Sections, headings, pages and
kinds are arithmetic on ids, chosen so that every rule of the operators meets rows that it applies to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(docs: DataFrame) -> DataFrame:
    pieces = F.array_remove(F.split(F.replace("text", F.lit(". "), F.lit("\n")), "\n"), "")
    return docs.where("text is not null and doc_id is not null").select("doc_id", F.coalesce("lang", F.lit("none")).alias("library_id"), F.coalesce("source", F.lit("")).alias("source"), pieces.alias("pieces"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # out of inline() the pieces are made once, not again for each of the filters that posexplode() brings
    lines = lines_of(table(spark, sf_dir, "documents")).select("doc_id", "library_id", "source", F.inline(F.array(F.struct("pieces"))))
    rows = lines.select("doc_id", "library_id", "source", F.posexplode("pieces").alias("ordinal", "text"))
    heading = """CASE WHEN (doc_id + ordinal) % 13 = 0 THEN '' WHEN doc_id % 7 = 0 THEN source
        WHEN doc_id % 4 = 1 THEN concat(source, ' > Glossary > Term ', ordinal)
        ELSE concat(source, ' > Part ', ordinal div 10, ' > Item ', ordinal div 2) END"""
    section = """CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN concat(ordinal % 7 + 1, '.1')
        ELSE concat(ordinal div 10 + 1, '.', ordinal % 10 + 1) END"""
    return rows.selectExpr(
        "library_id",
        "doc_id",
        "doc_id * 1000000 + ordinal AS chunk_id",
        "ordinal",
        f"{section} AS section",
        f"{heading} AS heading_path",
        "text",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ordinal div 4 + 1 + IF(ordinal div 4 >= 3, 1, 0) END AS page_start",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE ordinal div 4 + 1 + IF(ordinal div 4 >= 3, 1, 0) END AS page_end",
        "CASE WHEN ordinal % 3 = 0 THEN doc_id % 3 ELSE 0 END AS image_count",
        "CASE WHEN ordinal % 17 = 5 THEN 'keyword-reference' ELSE 'prose' END AS kind",
    ).withColumns({"page_start": F.col("page_start").cast("int"), "page_end": F.col("page_end").cast("int")})


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, numbered so that after every eleven of a document one number is left out."""
    return chunks(spark, sf_dir).withColumn("ordinal", F.expr("ordinal + ordinal div 11"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(table(spark, sf_dir, "documents")).select(
        "library_id",
        "doc_id",
        F.concat("source", F.lit("/"), "doc_id").alias("title"),
        F.size("pieces").cast("long").alias("chunk_count"),
        F.when(F.col("doc_id") % 3 != 0, F.floor(F.size("pieces") / 4) + 3).cast("int").alias("page_count"),
        F.when(F.col("doc_id") % 11 == 0, "ingesting").otherwise("ready").alias("status"),
    )


def ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("status = 'ready'").select("library_id", "doc_id")


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first long plain word of every seventh chunk, filed under that chunk's section."""
    return (
        chunks(spark, sf_dir)
        .where("ordinal % 7 = 3 AND section IS NOT NULL")
        .select("library_id", "doc_id", F.lower(F.regexp_extract("text", "[A-Za-z]{5,}", 0)).alias("term"), F.when(F.col("doc_id") % 6 == 0, F.concat("section", F.lit(".9"))).otherwise(F.col("section")).alias("section"))
        .where("term <> ''")
        .distinct()
    )


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).withColumn("tokens", T.token_estimate(F.col("text")))


def enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks with sizes, those of every tenth document fifty times as large."""
    return sized(spark, sf_dir).withColumn("tokens", F.expr("tokens * IF(doc_id % 10 = 3, 50, 1)"))


def footed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks, every second one of which is a page's footer."""
    footer = "CASE WHEN ordinal % 2 = 0 THEN concat('Printed for the reader, page ', ordinal, ' of the manual') ELSE text END"
    return chunks(spark, sf_dir).withColumn("text", F.expr(footer))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))


def libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS library_id", "CASE WHEN n_nationkey % 6 <> 5 THEN lower(n_name) END AS slug", "CAST(n_nationkey * 3 AS BIGINT) AS owner_id",
        "CASE WHEN n_nationkey % 10 = 7 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(n_nationkey - 7 AS INT)) END AS deleted_at",
        "CASE WHEN n_nationkey % 10 = 7 THEN CAST(n_nationkey * 2 AS BIGINT) END AS deleted_by",
    )


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_nationkey AS library_id", "c_custkey AS user_id", "element_at(array('reader', 'editor', 'admin'), CAST(c_custkey % 3 + 1 AS INT)) AS role")


def owned_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All grants, where libraries with an odd key have no admin but their owner."""
    held = grants(spark, sf_dir).selectExpr("library_id", "user_id", "CASE WHEN library_id % 2 = 1 AND role = 'admin' THEN 'editor' ELSE role END AS role")
    return held.unionByName(libraries(spark, sf_dir).selectExpr("library_id", "owner_id AS user_id", "'admin' AS role"))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").selectExpr("o_orderkey % 20 AS group_id", "o_custkey AS user_id").distinct()


def group_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey % 20 AS group_id", "s_nationkey AS library_id", "CASE WHEN s_suppkey % 2 = 0 THEN 'reader' ELSE 'editor' END AS role").distinct()


NOW = "TIMESTAMP_NTZ '2024-01-20 12:00:00'"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "CAST(user_id % 25 AS INT) AS library_id", "user_id AS requested_by", "concat('src-', user_id % 40, '-', event_id % 50) AS source",
        "element_at(array('queued', 'running', 'done', 'failed', 'cancelled'), CAST(event_id % 5 + 1 AS INT)) AS status",
        "CAST(event_id % 4 AS INT) AS attempts", "event_id % 17 = 0 AS cancel_req", "ts AS created_at", "ts + INTERVAL 1 HOUR AS updated_at",
        "CASE WHEN event_id % 5 = 1 THEN ts + INTERVAL 300 SECOND END AS lease_until", "event_id % 90 AS cur", "event_id % 100 AS total",
    )


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "ts AS at", "user_id AS actor_id", "event_type AS action", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 7 % 3000 END AS subject_id",
        "concat('was-', user_id) AS actor_name", "CASE WHEN event_id % 3 = 0 THEN concat('gone-', event_id % 50) END AS subject_name",
    )
