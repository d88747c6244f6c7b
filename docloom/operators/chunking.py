"""Blocks into chunks: islands and kinds as plans, the sequential rules as one kernel a document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.chunkrules import chunk_rows

#: What a heading that declares a listing says, and how large and how named its family is.
LISTING = r"(?iU)\b(?:keywords?|glossary|error\s+(?:codes?|messages?)|(?:command|api|syntax|function)\s+(?:reference|index|listing))\b"
FAMILY_FROM, LEAF_WORDS, LEAF_RATE = 30, 4, 0.6


def islands(blocks: DataFrame, key: str, order: str, same: list[str]) -> DataFrame:
    """Adds unit: the number of the run of consecutive rows that agree (null-safely) on the columns."""
    w = Window.partitionBy(key).orderBy(order)
    starts = F.lag(F.lit(1)).over(w).isNull()
    for c in same:
        starts = starts | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return blocks.withColumn("_starts", starts.cast("int")).withColumn("unit", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_starts")


def classify_kinds(chunks: DataFrame) -> DataFrame:
    """Sets kind to keyword-reference for the members of large families of short leaves under a listing heading.

    A family is the shallowest proper ancestor that declares a listing.
    """
    parts = T.path_parts(F.col("heading_path"))
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    declaring = F.filter(depths, lambda n: F.element_at(parts, n).rlike(LISTING))
    family = F.when(F.size(declaring) > 0, F.array_join(F.slice(parts, F.lit(1), F.element_at(declaring, 1)), T.PATH_SEP))
    short = F.size(F.regexp_extract_all(T.leaf(F.col("heading_path")), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), 0)) <= LEAF_WORDS
    marked = chunks.drop("kind").withColumn("_family", family)
    sizes = marked.where("_family is not null").groupBy("doc_id", "_family").agg(F.count("*").alias("n"), F.count_if(short).alias("named"))
    large = sizes.where((F.col("n") >= FAMILY_FROM) & (F.col("named") / F.col("n") >= LEAF_RATE)).select("doc_id", "_family", F.lit("keyword-reference").alias("kind"))
    return marked.join(large, ["doc_id", "_family"], "left").withColumn("kind", F.coalesce("kind", F.lit("prose"))).drop("_family")


CHUNK = (
    "ordinal int, heading_path string, text string, section string, page_start int, page_end int, printed_page_start int, "
    "url string, fragment string, image_count int"
)


#: Characters of chunks that an Arrow batch goes out with.
BATCH_CHARS = 1 << 20


def chunk_documents(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of each document's blocks; ``blocks`` has key, block_no and the block fields (see chunkrules).

    The rules feed each merge into the next, so a document is one kernel call; a partition's documents follow each
    other in one stream of batches, and a call holds one document's blocks. Kinds are set afterwards by
    classify_kinds.
    """
    kind = blocks.schema[key].dataType.simpleString()
    columns = [c.strip().split(" ") for c in CHUNK.split(",")]
    types = {"int": pa.int32(), "string": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, held, size = [], [], [], 0

        def close(out: pa.DataType) -> pa.RecordBatch:
            arrays = [pa.array(keys, out), *(pa.array([r[name] for r in rows], types[t]) for name, t in columns)]
            return pa.RecordBatch.from_arrays(arrays, [key, *(name for name, _ in columns)])

        def take() -> int:
            found = chunk_rows(held)
            rows.extend(found)
            keys.extend([held[0][key]] * len(found))
            held.clear()
            return sum(len(r["text"]) for r in found)

        out = None
        for batch in batches:
            out = batch.schema.field(key).type
            for row in batch.to_pylist():
                if held and not _same(row[key], held[0][key]):
                    size += take()
                    if size > BATCH_CHARS:
                        yield close(out)
                        keys, rows, size = [], [], 0
                held.append(row)
        if held:
            take()
            yield close(out)

    placed = blocks.repartition(key).sortWithinPartitions(key, "block_no")
    return placed.mapInArrow(cut, f"{key} {kind}, {CHUNK}")


def _same(a, b) -> bool:
    """Whether two keys are one group; so are two nulls, and two that are no number."""
    return a == b or (a != a and b != b)
