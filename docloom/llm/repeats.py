"""Routing of repeated passages to shards, shared by the two exact substring operators.

Two equal windows of ``window`` symbols have the same anchor, the least hash among their ``gram``-grams
(leftmost of equals), at the same place. Runs of windows with one anchor are segments. So:

1. a map gives each row the set of its anchors; a grouped count (combined before the shuffle, so hot anchors
   cost one row a task) keeps those of two rows, or twice in one. They set bits of a bitmap, sized from their
   number up to MOST_BITS and broadcast. A bitmap that fills up lets more segments through and changes no result.
2. a second map cuts each row into segments of anchors in the bitmap and gives their keys only (hash, anchor,
   place). Equal segments fold into the first of them, in the task and then in a grouped aggregation.
3. bodies (bytes of the text) of these distinct segments go to shards by anchor: a map fetches them by a bitmap
   of their places or, where that would pass MOST_BITS, by a join of texts and places. Segments of anchors with more than HOT
   distinct ones go as single windows by the window's hash, equal ones of a task as their first. A segment alone
   with its anchor shares no window with another and needs no shard: its first occurrence is kept.
4. a shard's index says of every window it holds whether it is the first of its kind: ``kept``. What is kept
   goes back to the documents, and every other window of a segment is gone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared as S
from docloom.llm.winnow import anchors, bitmap, in_bitmap

#: Bits of a broadcast bitmap: at least, at most (64 MB), and for each key as long as that allows.
LEAST_BITS, MOST_BITS, PER_KEY = 20, 29, 16
#: Distinct segments of one anchor beyond which they are dealt out by window.
HOT = 10_000
#: Rows that a task folds before it sends them on.
BUFFER = 1 << 19


@dataclass(frozen=True)
class Rules:
    """What symbols are and how long a window is."""

    window: int
    gram: int
    #: Bytes and offsets to (hash values, first symbol of each document, first and last + 1 byte of each symbol).
    split: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: Symbols of a shard, about.
    shard_symbols: int
    #: Whether an earlier start in the same document counts; if not, only a smaller id does.
    within: bool


@dataclass(frozen=True)
class Bitmap:
    """A broadcast set of 64-bit keys that may hold more than was put in; without a table it holds all."""

    table: np.ndarray | None
    bits: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return np.ones(len(keys), bool) if self.table is None else in_bitmap(self.table, keys, self.bits)


def bits_for(count: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (PER_KEY * count).bit_length()))


def bitmap_of(keys: DataFrame, column: str, count: int) -> Bitmap:
    bits = bits_for(count)
    return Bitmap(bitmap(keys, column, bits), bits)


def _anchor_rows(rules: Rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in S.text_blocks(batch["text"]):
                values, first, _, _ = rules.split(data, off)
                grams = S.SpanHash(values).fixed(rules.gram)
                at = anchors(values, first, rules.window, rules.gram, grams)
                owner = np.searchsorted(first, at, "right") - 1
                key = S.mix(grams[at])
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(S.signed(key[at])), pa.array(times > 1)], ["anchor", "twice"])

    return made


def repeated_anchors(docs: DataFrame, rules: Rules) -> Bitmap:
    """The bitmap of anchors that occur in two rows or, where that counts, twice in one."""
    rows = docs.select("text").mapInArrow(_anchor_rows(rules), "anchor long, twice boolean")
    found = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice"))
    found = S.written(found.where("n > 1 or twice" if rules.within else "n > 1").select("anchor"), "anchors")
    table = bitmap_of(found, "anchor", found.count())
    S.removed(found)
    return table


@dataclass
class Segments:
    """Runs of windows of a block with one repeated anchor; ``start`` counts symbols of the block, ``place`` those of the document."""

    owner: np.ndarray
    start: np.ndarray
    place: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    key: np.ndarray

    def take(self, at: np.ndarray) -> Segments:
        return Segments(*(getattr(self, c)[at] for c in ("owner", "start", "place", "windows", "anchor", "key")))


def segments(values: np.ndarray, first: np.ndarray, rules: Rules, repeated: Bitmap) -> Segments:
    if len(values) < rules.window:
        return Segments(*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(2)))
    spans = S.SpanHash(values)
    grams = spans.fixed(rules.gram)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (S.window_min(packed, rules.window - rules.gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    count = np.maximum(np.diff(first) - rules.window + 1, 0)
    windows = S.ragged(first[:-1], count)
    anchor = anchor[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(windows) != 1) | (anchor[1:] != anchor[:-1])
    at = np.flatnonzero(new)
    owner = np.repeat(np.arange(len(count)), count)[at]
    start, runs, anchor = windows[at], np.diff(np.append(at, len(windows))), S.mix(grams[anchor[at]])
    good = repeated.holds(anchor)
    owner, start, runs, anchor = owner[good], start[good], runs[good], anchor[good]
    return Segments(owner, start, start - first[owner], runs, anchor, spans(start, start + runs + rules.window - 1))


def _second(values: np.ndarray, found: Segments, rules: Rules) -> np.ndarray:
    """A second hash of the segments."""
    return S.SpanHash(S.mix(values ^ np.uint64(0xD1B54A32D192ED03)))(found.start, found.start + found.windows + rules.window - 1)


def _first_of_each(key: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows with the least (id, place) of each key."""
    order = np.lexsort((place, ids, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return order[new]


_KEYS = {"k1": np.int64, "k2": np.int64, "anchor": np.int64, "id": np.int64, "start": np.int64, "windows": np.int32}


def _key_rows(rules: Rules, shipped) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def folded() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            keep = _first_of_each(columns[0], columns[3], columns[4])
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], list(_KEYS))

        for batch in batches:
            ids = batch["id"].to_numpy()
            for lo, _, data, off in S.text_blocks(batch["text"]):
                values, first, _, _ = rules.split(data, off)
                found = segments(values, first, rules, shipped.value)
                if not len(found.key):
                    continue
                of = ids[lo + found.owner]
                columns = [S.signed(found.key), S.signed(_second(values, found, rules)), S.signed(found.anchor), of, found.place, found.windows.astype(np.int32)]
                keep = _first_of_each(columns[0], of, found.place)
                held.append([c[keep] for c in columns])
                rows += len(keep)
                if rows > BUFFER:
                    yield folded()
                    held, rows = [], 0
        if held:
            yield folded()

    return made


def _spot(key, ids, place):
    """Where a segment's first occurrence is looked up in a bitmap; the same in numpy and, by _spot_column, in Spark."""
    return key ^ (ids << 40).view(np.uint64) ^ (place << 36).view(np.uint64)


def _spot_column():
    return F.col("k1").bitwiseXOR(F.shiftleft("id", 40)).bitwiseXOR(F.shiftleft(F.col("start").cast("long"), 36))


#: A row of a shard: places are (segment, its start, first window) that the body stands for.
_BODY = "route long, id long, start long, windows int, places array<struct<k1:long,start:long,begin:int>>, body binary"
_KEPT = "id long, k1 long, start long, begin int, windows int"


def _body_batch(route, ids, start, windows, counts, places, data, lo, hi) -> pa.RecordBatch:
    """Rows of _BODY; bodies are data[lo..hi]."""
    cut = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(hi - lo, out=cut[1:])
    body = np.ascontiguousarray(data[S.ragged(lo, hi - lo)])
    k1, at, begin = places
    items = pa.StructArray.from_arrays([pa.array(S.signed(k1)), pa.array(at), pa.array(begin.astype(np.int32))], ["k1", "start", "begin"])
    off = np.zeros(len(lo) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    bodies = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(body)])
    return pa.RecordBatch.from_arrays(
        [pa.array(S.signed(route)), pa.array(ids), pa.array(start), pa.array(windows.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), items), bodies],
        ["route", "id", "start", "windows", "places", "body"],
    )


class _Singles:
    """Single windows of hot anchors that a task holds back: of equal ones, those of the first document or place."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.held: list[list[np.ndarray]] = []
        self.rows = 0

    def add(self, found: Segments, ids: np.ndarray, values: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        segment = np.repeat(np.arange(len(found.key)), found.windows)
        step = np.arange(len(segment)) - np.repeat(np.cumsum(found.windows) - found.windows, found.windows)
        at = found.start[segment] + step
        key = S.SpanHash(values)(at, at + self.rules.window)
        place = found.place[segment] + step
        self._hold([key, ids[segment], place, found.key[segment], found.place[segment], step], data, begin[at], end[at + self.rules.window - 1])

    def _hold(self, columns: list[np.ndarray], data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        keep = self._firsts(*columns[:3])
        lo, hi = lo[keep], hi[keep]
        self.held.append([*(c[keep] for c in columns), data[S.ragged(lo, hi - lo)], hi - lo])
        self.rows += len(keep)

    def _firsts(self, key: np.ndarray, ids: np.ndarray, place: np.ndarray) -> np.ndarray:
        order = np.lexsort((place, ids, key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        if self.rules.within:
            return order[new]
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        return order[ids[order] == ids[order][head]]

    def sent(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        *columns, data, size = columns
        self.held, self.rows = [], 0
        hi = np.cumsum(size)
        order = self._firsts(*columns[:3])
        key, ids, place, k1, start, step = (c[order] for c in columns)
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        head = np.flatnonzero(new)
        counts = np.diff(np.append(head, len(order)))
        row = order[head]
        yield _body_batch(key[head], ids[head], place[head], np.ones(len(head), np.int64), counts, (k1, start, step), data, hi[row] - size[row], hi[row])


def _body_rows(rules: Rules, shipped, listed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bodies of first occurrences: those that a bitmap holds or, ``listed``, those of the column "wanted"."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, firsts, several, hot = shipped.value
        singles = _Singles(rules)
        for batch in batches:
            ids = batch["id"].to_numpy()
            for lo, hi, data, off in S.text_blocks(batch["text"]):
                values, first, begin, end = rules.split(data, off)
                if listed:
                    found = _listed(values, first, rules, batch["wanted"].slice(lo, hi - lo))
                else:
                    found = segments(values, first, rules, repeated)
                    found = found.take(np.flatnonzero(firsts.holds(_spot(found.key, ids[lo + found.owner], found.place))))
                found = found.take(np.flatnonzero(several.holds(found.anchor)))
                if not len(found.key):
                    continue
                many = hot.holds(found.anchor) if hot is not None else np.zeros(len(found.key), bool)
                some = found.take(np.flatnonzero(many))
                if len(some.key):
                    singles.add(some, ids[lo + some.owner], values, data, begin, end)
                    if singles.rows > BUFFER:
                        yield from singles.sent()
                some = found.take(np.flatnonzero(~many))
                if len(some.key):
                    last = some.start + some.windows + rules.window - 2
                    places = some.key, some.place, np.zeros(len(some.key), np.int64)
                    yield _body_batch(some.anchor, ids[lo + some.owner], some.place, some.windows, np.ones(len(some.key), np.int64), places, data, begin[some.start], end[last])
        yield from singles.sent()

    return made


def _listed(values: np.ndarray, first: np.ndarray, rules: Rules, wanted: pa.Array) -> Segments:
    """The wanted segments (k1, start, windows, anchor) of rows, where the row really has them."""
    off = wanted.offsets.to_numpy().astype(np.int64)
    items = wanted.values.slice(off[0], off[-1] - off[0])
    owner = np.repeat(np.arange(len(wanted)), np.diff(off))
    k1, place, runs, anchor = (items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
    fits = np.flatnonzero(first[owner] + place + runs + rules.window - 1 <= first[owner + 1])
    owner, k1, place, runs, anchor = owner[fits], k1[fits].view(np.uint64), place[fits], runs[fits], anchor[fits].view(np.uint64)
    start = first[owner] + place
    same = np.flatnonzero(S.SpanHash(values)(start, start + runs + rules.window - 1) == k1)
    return Segments(owner, start, place, runs, anchor, k1).take(same)


def _alone(several: Bitmap) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments that have no other with their anchor, kept as a whole; exactly those whose bodies no task sends."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~several.holds(batch["anchor"].to_numpy().view(np.uint64))))
            begin = pa.array(np.zeros(part.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays([part["id"], part["k1"], part["start"], begin, part["windows"]], ["id", "k1", "start", "begin", "windows"])

    return made


def kept_windows(docs: DataFrame, rules: Rules, shard: Callable[[pa.Table], pa.Table], repeated) -> DataFrame:
    """id and kept: an array of (k1, start, begin, windows), the windows of segments that are the first of their kind.

    ``docs`` has id (long) and text; ``repeated`` is the broadcast bitmap of anchors. ``shard`` maps a table of
    _BODY without route, in order of (id, start), to rows of _KEPT.
    """
    spark = docs.sparkSession
    rows = docs.select("id", "text").mapInArrow(_key_rows(rules, repeated), "k1 long, k2 long, anchor long, id long, start long, windows int")
    least = F.min(F.struct("id", "start", "anchor", "windows")).alias("least")
    distinct = S.written(rows.groupBy("k1", "k2").agg(least).select("k1", "least.*"), "segments")
    number = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("windows").alias("w"))
    more = rules.window - 1
    size = F.when(F.col("n") > HOT, F.col("w") * rules.window).when(F.col("n") > 1, F.col("w") + F.col("n") * more)
    count, symbols, pairs, many = number.agg(F.sum("n"), F.sum(size), F.count(F.when(F.col("n") > 1, 1)), F.count(F.when(F.col("n") > HOT, 1))).first()
    several = bitmap_of(number.where("n > 1"), "anchor", pairs)
    hot = bitmap_of(number.where(F.col("n") > HOT), "anchor", many) if many else None
    shards = max(1, round((symbols or 0) / rules.shard_symbols))
    if PER_KEY * (count or 0) <= 4 << MOST_BITS:
        firsts = bitmap_of(distinct.select(_spot_column().alias("spot")), "spot", count or 0)
        source, listed = docs.select("id", "text"), False
    else:
        wanted = distinct.groupBy("id").agg(F.collect_list(F.struct("k1", "start", "windows", "anchor")).alias("wanted"))
        firsts, source, listed = None, docs.select("id", "text").join(wanted, "id"), True
    bodies = source.mapInArrow(_body_rows(rules, spark.sparkContext.broadcast((repeated.value, firsts, several, hot)), listed), _BODY)

    def ordered(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.lexsort((table["start"].to_numpy(), table["id"].to_numpy()))
        return shard(table.take(pa.array(order)))

    dealt = bodies.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).select("shard", "id", "start", "windows", "places", "body")
    found = dealt.groupBy("shard").applyInArrow(ordered, _KEPT)
    kept = S.written(found.unionByName(distinct.mapInArrow(_alone(several), _KEPT)), "kept")
    S.removed(distinct)
    return kept.groupBy("id").agg(F.collect_list(F.struct("k1", "start", "begin", "windows")).alias("kept"))


def windows_of(table: pa.Table, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: bytes of all bodies, their symbols' values and first symbols, the segment of each window and its first symbol."""
    data, off = S.utf8(table["body"].combine_chunks())
    values, first, _, _ = rules.split(data, off)
    count = table["windows"].to_numpy().astype(np.int64)
    return data, values, first, np.repeat(np.arange(len(count)), count), S.ragged(first[:-1], count)


def kept_table(table: pa.Table, first: np.ndarray, segment: np.ndarray, place: np.ndarray, kept: np.ndarray) -> pa.Table:
    """Runs of windows that are ``kept``, as rows of _KEPT for each of their places; windows are in order."""
    at = np.flatnonzero(kept)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(segment[at]) != 0)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    row, step = segment[at[head]], (place - first[segment])[at[head]]
    lists = table["places"].combine_chunks()
    off = lists.offsets.to_numpy().astype(np.int64)
    many = np.diff(off)[row]
    item = pa.array(S.ragged(off[row], many))
    k1, start, begin = (lists.values.field(k).take(item) for k in range(3))
    ids = table["id"].combine_chunks().take(pa.array(np.repeat(row, many)))
    moved = pc.add(begin, pa.array(np.repeat(step, many).astype(np.int32)))
    return pa.table([ids, k1, start, moved, pa.array(np.repeat(count, many).astype(np.int32))], ["id", "k1", "start", "begin", "windows"])


def gone_symbols(values: np.ndarray, first: np.ndarray, rules: Rules, repeated: Bitmap, kept: pa.Array) -> np.ndarray:
    """Flags of a block's symbols that a window covers which is in a segment and not kept; ``kept`` has a list for each row."""
    found = segments(values, first, rules, repeated)
    n = len(values)
    if not len(found.key):
        return np.zeros(n, bool)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, found.start, 1)
    np.add.at(change, found.start + found.windows, -1)
    inside = np.cumsum(change)[:-1] > 0
    lists = pc.fill_null(kept, []) if kept.null_count else kept
    off = lists.offsets.to_numpy().astype(np.int64)
    items = lists.values.slice(off[0], off[-1] - off[0])
    if len(items):
        of = np.repeat(np.arange(len(lists)), np.diff(off)).astype(np.uint64)
        k1, start, begin, runs = (items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
        key = S.mix(k1.view(np.uint64) ^ S.mix(of))
        order = np.argsort(key, kind="stable")
        mine = S.mix(found.key ^ S.mix(found.owner.astype(np.uint64)))
        lo, hi = np.searchsorted(key[order], mine, "left"), np.searchsorted(key[order], mine, "right")
        segment, item = np.repeat(np.arange(len(mine)), hi - lo), order[S.ragged(lo, hi - lo)]
        if rules.within:
            same = found.place[segment] == start[item]
            segment, item = segment[same], item[same]
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, found.start[segment] + begin[item], 1)
        np.add.at(change, found.start[segment] + begin[item] + runs[item], -1)
        inside &= np.cumsum(change)[:-1] == 0
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    change = np.zeros(n + rules.window + 1, np.int32)
    np.add.at(change, a, 1)
    np.add.at(change, b + rules.window - 1, -1)
    return np.cumsum(change)[:n] > 0


#: What is left of a block: (bytes, offsets, first, begin, end, gone) to columns after doc_id.
Report = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]


def without_repeats(docs: DataFrame, rules: Rules, shard: Callable[[pa.Table], pa.Table], report: Report, schema: str) -> DataFrame:
    """doc_id and the report's columns (``schema``) of every row."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(S.NULL_ID)).alias("id"))
    repeated = spark.sparkContext.broadcast(repeated_anchors(keyed, rules))
    kept = kept_windows(keyed, rules, shard, repeated)
    names = ["doc_id", *(c.strip().split(" ")[0] for c in schema.split(","))]

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in S.text_blocks(batch["text"]):
                values, first, begin, end = rules.split(data, off)
                part = batch.slice(lo, hi - lo)
                gone = gone_symbols(values, first, rules, repeated.value, part["kept"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], *report(data, off, first, begin, end, gone)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.join(kept, "id", "left").select("doc_id", "text", "kept").mapInArrow(done, f"doc_id {kind}, {schema}")
