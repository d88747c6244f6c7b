"""Benchmark decontamination by winnowing.

Words are hashed; of every 13 consecutive words the least 5-gram hash (leftmost of equals) is a
fingerprint, of documents and of benchmark items alike, so every shared span of 13 words shares one at
the same place. An item of fewer words is one window; its least k-gram (k = 5, or its length) stands for
it and is looked for at every position. Fingerprints meet in an equi-join, each with the words around
it, and a hit is extended left and right while words agree; it counts when the agreement is as long as
the item's window.

A bitmap of fixed size (512 KB) of the items' fingerprints, broadcast, drops most documents' fingerprints
before the join; when a large benchmark fills it, more rows reach the join and nothing else changes.
Items that agree around a fingerprint are folded before the join, and Spark splits keys that are hot on
the documents' side (adaptive skew join).

Defined cases: null and empty texts have no words and are never hit; items without words occur nowhere;
null item ids are kept out of lists; repeated rows each give a row; extra columns are ignored; an empty
benchmark or table works.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared as S

WINDOW, GRAM = 13, 5
BITMAP_BITS = 22
_REACH = WINDOW - 1
_MATCH = "array<struct<fp:long,pos:int,at:int,words:array<long>>>"


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, gram: int, gram_hash: np.ndarray) -> np.ndarray:
    """Positions of the least ``gram``-gram of each window of ``window`` values inside one document; sorted, distinct."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    packed = (gram_hash & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram_hash), dtype=np.uint64)
    least = S.window_min(packed, window - gram + 1)
    inside = np.ones(len(least), bool)
    edge = first[1:-1]
    if len(edge):
        start = np.clip(edge - window + 1, 0, len(least))
        mark = np.zeros(len(least) + 1, np.int64)
        np.add.at(mark, start, 1)
        np.add.at(mark, np.clip(edge, 0, len(least)), -1)
        inside = np.cumsum(mark)[:-1] == 0
    return np.unique((least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64))


def _hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, S.SpanHash]:
    low = S.LOWER[data]
    start, end, first = S.words(low, off, S.ALNUM)
    h = S.SpanHash(S.BYTE_VALUE[low])(start, end)
    return h, first, S.SpanHash(h)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of items: fp, gram (its words), at (its place in words), need, words."""
    for batch in batches:
        for lo, hi, data, off in S.text_blocks(batch["text"]):
            h, first, spans = _hashed(data, off)
            item, fp, gram, at, need, context = [], [], [], [], [], []
            long_at = anchors(h, first, WINDOW, GRAM, spans.fixed(GRAM))
            owner = np.searchsorted(first, long_at, "right") - 1
            for p, d in zip(long_at.tolist(), owner.tolist(), strict=True):
                a, b = max(first[d], p - _REACH), min(first[d + 1], p + GRAM + _REACH)
                item.append(d), gram.append(GRAM), at.append(p - a), need.append(WINDOW), context.append(h[a:b])
                fp.append(spans(np.array([p]), np.array([p + GRAM]))[0])
            n = np.diff(first)
            for d in np.flatnonzero((n > 0) & (n < WINDOW)).tolist():
                k = min(GRAM, int(n[d]))
                starts = np.arange(first[d], first[d + 1] - k + 1)
                grams = spans(starts, starts + k)
                p = int(grams.argmin())
                item.append(d), gram.append(k), at.append(p), need.append(int(n[d])), context.append(h[first[d] : first[d + 1]])
                fp.append(grams[p])
            flat = np.concatenate([*context, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["item_id"].slice(lo, hi - lo).take(pa.array(item, pa.int64())),
                    pa.array(S.signed(np.array(fp, np.uint64))),
                    pa.array(gram, pa.int32()),
                    pa.array(at, pa.int32()),
                    pa.array(need, pa.int32()),
                    S.list_column(S.signed(flat), np.array([len(c) for c in context], np.int64), pa.int64()),
                ],
                ["item_id", "fp", "gram", "at", "need", "words"],
            )


def item_fingerprints(items: DataFrame) -> DataFrame:
    """fp, gram, at, need, words, and the items (sorted ids) that agree in all of these."""
    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", "text").mapInArrow(_item_rows, f"item_id {kind}, fp long, gram int, at int, need int, words array<long>")
    return rows.groupBy("fp", "gram", "at", "need", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with the leading bits of each key set; its size does not depend on the rows."""
    place = F.shiftrightunsigned(column, 64 - bits)
    rows = keys.select(F.shiftright(place, 15).alias("page"), place.bitwiseAND(32767).alias("bit")).groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("set")).collect()
    out = np.zeros((max(1, 1 << max(0, bits - 15)), 4096), np.uint8)
    for r in rows:
        out[r["page"]] = np.frombuffer(bytes(r["set"]), np.uint8)
    return out.ravel()


def in_bitmap(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    place = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def document_hits(docs: DataFrame, fingerprints: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_words, hits (possible fingerprints with their places and surrounding words) of every row; map only."""
    spark = docs.sparkSession
    long_map = bitmap(fingerprints.where(F.col("need") == WINDOW), "fp", BITMAP_BITS)
    short = fingerprints.where(F.col("need") < WINDOW)
    short_map = bitmap(short, "fp", BITMAP_BITS)
    grams = sorted(r["gram"] for r in short.select("gram").distinct().collect())  # at most GRAM values
    shipped = spark.sparkContext.broadcast((long_map, short_map))
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry), "n_words long", f"hits {_MATCH}"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_set, short_set = shipped.value
        for batch in batches:
            for lo, hi, data, off in S.text_blocks(batch["text"]):
                h, first, spans = _hashed(data, off)
                at, keys = [], []
                five = spans.fixed(GRAM)
                p = anchors(h, first, WINDOW, GRAM, five)
                hit = p[in_bitmap(long_set, five[p], BITMAP_BITS)]
                at.append(hit), keys.append(five[hit])
                for k in grams:
                    every = five if k == GRAM else spans.fixed(k)
                    hit = np.flatnonzero(in_bitmap(short_set, every, BITMAP_BITS))
                    hit = hit[hit + k <= first[np.searchsorted(first, hit, "right")]]
                    at.append(hit), keys.append(every[hit])
                at, keys = np.concatenate(at), np.concatenate(keys)
                order = np.lexsort((keys, at))
                at, keys = at[order], keys[order]
                owner = np.searchsorted(first, at, "right") - 1
                a = np.maximum(first[owner], at - _REACH)
                b = np.minimum(first[owner + 1], at + GRAM + _REACH)
                words = S.list_column(S.signed(h[S.ragged(a, b - a)]), b - a, pa.int64())
                matches = pa.StructArray.from_arrays(
                    [pa.array(S.signed(keys)), pa.array(at - first[owner], pa.int32()), pa.array(at - a, pa.int32()), words], ["fp", "pos", "at", "words"]
                )
                per = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(np.bincount(owner, minlength=hi - lo), out=per[1:])
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(lo, hi - lo) for c in carry), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(per), matches)], [*carry, "n_words", "hits"]
                )

    return docs.select(*carry, "text").mapInArrow(found, schema)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Agreement around a fingerprint: start and stop (document words) where it is long enough."""
    for batch in batches:
        n = batch.num_rows
        sides = []
        for words, at in (("words", "at"), ("item_words", "item_at")):
            off = batch[words].offsets.to_numpy().astype(np.int64)
            sides.append((batch[words].values.to_numpy(zero_copy_only=False), off[:-1], off[1:], off[:-1] + batch[at].to_numpy()))
        (x, x_lo, x_hi, x_at), (y, y_lo, y_hi, y_at) = sides
        gram = batch["gram"].to_numpy()
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        going = np.arange(n)
        for step in range(1, _REACH + 1):
            a, b = x_at[going] - step, y_at[going] - step
            going = going[(a >= x_lo[going]) & (b >= y_lo[going])]
            going = going[x[x_at[going] - step] == y[y_at[going] - step]]
            left[going] = step
        going = np.arange(n)
        for step in range(WINDOW + _REACH):
            a, b = x_at[going] + step, y_at[going] + step
            going = going[(a < x_hi[going]) & (b < y_hi[going])]
            going = going[x[x_at[going] + step] == y[y_at[going] + step]]
            right[going] = step + 1
        good = np.flatnonzero((right >= gram) & (left + right >= batch["need"].to_numpy()))
        pos = batch["pos"].to_numpy()[good]
        yield pa.RecordBatch.from_arrays(
            [*(batch[c].take(pa.array(good)) for c in ("row", "need", "items")), pa.array(pos - left[good], pa.int64()), pa.array(pos + right[good], pa.int64())],
            ["row", "need", "items", "start", "stop"],
        )


def contamination(docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, n_words, n_hit, items (sorted ids of items with occurring windows) and longest (words of the longest such window, 0 without) of every row."""
    prints = S.cut(item_fingerprints(items))
    rows = S.written(document_hits(docs, prints, carry).withColumn("row", F.monotonically_increasing_id()), "hits")
    kind = prints.schema["items"].dataType.simpleString()
    pairs = (
        rows.select("row", F.explode("hits").alias("h"))
        .select("row", "h.fp", "h.pos", "h.at", "h.words")
        .join(prints.select("fp", "gram", "need", F.col("at").alias("item_at"), F.col("words").alias("item_words"), "items"), "fp")
    )
    spans = pairs.mapInArrow(_extended, f"row long, need int, items {kind}, start long, stop long")
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["stop"]).alias("upto")
    )
    found = spans.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.max("need").alias("longest")
    )
    found = found.select("row", F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), step)["n"].alias("n_hit"), "items", "longest")
    return rows.select("row", *carry, "n_words").join(found, "row", "left").select(
        *carry, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.array_sort(F.coalesce("items", F.array().cast(kind))).alias("items"), F.coalesce("longest", F.lit(0)).alias("longest")
    )


def contaminated(n_hit, n_words):
    """A document is contaminated when at least one word in twenty is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows and columns of documents that neither hold a whole window of 13 words nor are contaminated by shorter items.

    Null and empty texts stay; repeated rows stay or go together; extra columns of any name are carried.
    """
    h, b, i = S.fresh(docs, "_hash", "_bad", "_id")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    found = contamination(keyed.select("doc_id", h, "text"), items, ("doc_id", h))
    bad = found.where((F.col("longest") >= WINDOW) | contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias(i), F.col(h).alias(b))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(b)), "left_anti").select(*docs.columns)
