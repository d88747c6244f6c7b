"""Plain text as ordered blocks: pieces between blank lines, with offsets in code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_blocks(docs: DataFrame, key: str) -> DataFrame:
    """key, block_no, offset, text of each non-blank piece; an offset counts all code points before it.

    Offsets are a fold inside the row, so no window is needed: a row's pieces never leave it.
    """
    pieces = F.split(F.coalesce("text", F.lit("")), "\n\n", -1)
    step = lambda s, x: F.struct((s["at"] + F.length(x) + 2).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    offsets = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), step)["out"]
    rows = docs.select(key, F.posexplode(F.filter(F.arrays_zip(offsets.alias("offset"), pieces.alias("text")), _visible)).alias("block_no", "p"))
    return rows.select(key, "block_no", "p.offset", "p.text")


def _visible(piece: Column) -> Column:
    return piece["text"].rlike(r"[^\s]")
