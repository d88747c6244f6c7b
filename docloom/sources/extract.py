"""Raw bodies to block tables: one Arrow-batched map, no shuffle; a document's blocks come out as one array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources import markup

BLOCK = "struct<heading_path:array<string>,fragment:string,text:string,offset:bigint>"


def _extracted(rows: DataFrame, read: Callable[[pa.RecordBatch, int], tuple[str, list[dict]]], keep: list[str]) -> DataFrame:
    """The kept columns, title, error (of a body that cannot be read, which then has no blocks) and blocks."""
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), "title string", "error string", f"blocks array<{BLOCK}>"])
    block = pa.list_(pa.struct([("heading_path", pa.list_(pa.string())), ("fragment", pa.string()), ("text", pa.string()), ("offset", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, errors, blocks = [], [], []
            for k in range(batch.num_rows):
                try:
                    title, found = read(batch, k)
                    error = None
                except Exception as e:  # a bad body is a row with an error, not a failed job
                    title, found, error = None, [], f"{type(e).__name__}: {e}"[:500]
                titles.append(title), errors.append(error), blocks.append(found)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(titles, pa.string()), pa.array(errors, pa.string()), pa.array(blocks, block)], [*keep, "title", "error", "blocks"])

    return rows.mapInArrow(run, schema)


def from_html(pages: DataFrame, keep: list[str], column: str = "html") -> DataFrame:
    return _extracted(pages.select(*keep, column), lambda batch, k: markup.html_blocks(batch[column][k].as_py() or ""), keep)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, title, error, blocks of every supported file below a path."""
    either = lambda suffix: "".join(f"[{c}{c.upper()}]" for c in suffix[1:])
    pattern = "*.{" + ",".join(map(either, markup.READERS)) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    rows = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    return _extracted(rows, lambda batch, k: markup.read_file(batch["path"][k].as_py(), batch["content"][k].as_py()), ["path", "sha256"])


def block_rows(extracted: DataFrame, keep: list[str]) -> DataFrame:
    """One row a block, with block_no."""
    return extracted.select(*keep, F.posexplode("blocks").alias("block_no", "b")).select(*keep, "block_no", "b.*")
