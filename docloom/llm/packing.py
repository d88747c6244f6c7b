"""Best-fit packing: minimum bin slack over tokenized documents.

A map tokenizes whole texts, appends the end id and cuts only documents longer than a sequence. Pieces
(a few numbers each, never tokens) are dealt by a hash of all that tells them apart, the row's number among
it, into groups of about GROUP pieces; each group is packed by itself. For each bin the longest piece left is placed, then a bitset dynamic programme over
the lengths that are left finds the fullest feasible sum, whose pieces are taken out. A group opens
at most one poorly filled bin, so what grouping costs is bounded by one bin in GROUP pieces.

Tokens come from a public vocabulary file whose path is a parameter. White space is dropped and never
joined by that vocabulary's rules, so a text's ids are those of its words in a row; each word is encoded
once per Python worker (plain Latin words by the file's merges in numpy, all others by the library) and
kept by its 64-bit hash in a table of bounded size.

Defined cases: a null text is empty, and is one piece that holds the end id alone; repeated rows are
separate documents whose pieces each get a place; null ids are kept; extra columns are ignored; an empty
table gives no rows. Sequence ids are any distinct numbers.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared as S
from docloom.llm.bpe import Merges

CAPACITY = 4096
END_ID = 1
#: Pieces that one group packs.
GROUP = 20_000
#: Words whose ids a worker keeps; beyond it the table starts anew after a block.
KEPT_WORDS = 1_500_000
#: Only these white-space bytes split words here; any other white space stays inside and is the tokenizer's business.
_INSIDE = ~S.byte_set((0x20, 0x20), (0x09, 0x0D))


class WordIds:
    """Ids of words by the words' hashes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(path)
        self.clear()

    def clear(self) -> None:
        self.table = S.HashTable(20)
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _room(self, more: int) -> None:
        """A table at most half full."""
        if 2 * (self.table.size + more) > 1 << self.table.bits:
            old, bits = self.table, self.table.bits + 1
            while 2 * (old.size + more) > 1 << bits:
                bits += 1
            keys = np.zeros(old.size, np.uint64)
            some = old.index >= 0
            keys[old.index[some]] = old.keys[some]
            self.table = S.HashTable(bits)
            self.table.add(keys)

    def _by_library(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row and their counts; words are joined so that one call encodes many."""
        counts, parts = np.zeros(len(start), np.int64), [np.zeros(0, np.uint32)]
        raw = data.tobytes()
        for lo in range(0, len(start), 64):
            group = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[lo : lo + 64].tolist(), end[lo : lo + 64].tolist(), strict=True)]
            e = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            if e.ids:
                at = np.searchsorted(np.cumsum([len(g) + 1 for g in group]), np.array([o[0] for o in e.offsets], np.int64), "right")
                counts[lo : lo + len(group)] = np.bincount(at, minlength=len(group))[: len(group)]
                parts.append(np.array(e.ids, np.uint32))
        return np.concatenate(parts), counts

    def _add(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        taken, ids, some = self.merges.words(data, start, end)
        rest, others = self._by_library(data, start[~taken], end[~taken])
        counts = np.zeros(len(keys), np.int64)
        counts[taken], counts[~taken] = some, others
        first = np.zeros(len(keys), np.int64)
        first[taken] = len(self.ids) + np.cumsum(some) - some
        first[~taken] = len(self.ids) + len(ids) + np.cumsum(others) - others
        self.ids = np.concatenate([self.ids, ids, rest])
        self.start, self.count = np.concatenate([self.start, first]), np.concatenate([self.count, counts])
        self._room(len(keys))
        self.table.add(keys)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, without end ids, and each document's first (one more than documents)."""
        start, end, first = S.words(data, off, _INSIDE)
        key = S.SpanHash(S.BYTE_VALUE[data])(start, end)
        if self.table.size > KEPT_WORDS:
            self.clear()
        number = self.table.find(key)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, at = np.unique(key[missing], return_index=True)
            self._add(new, data, start[missing[at]], end[missing[at]])
            number[missing] = self.table.find(key[missing])
        n = self.count[number]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        return self.ids[S.ragged(self.start[number], n)], upto[first]


_encoders: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, row (its number in its task), piece, start, length, ids_crc32 of every document; map only."""
    schema = f"{docs.select('doc_id').schema[0].simpleString().replace(':', ' ')}, row long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _encoders:
            _encoders[tokenizer_path] = WordIds(tokenizer_path)
        encoder, seen = _encoders[tokenizer_path], 0
        for batch in batches:
            for lo, hi, data, off in S.text_blocks(batch["text"], 2 * S.BLOCK_BYTES):
                ids, first = encoder.encode(data, off)
                n = np.diff(first) + 1
                flat = np.full(int(n.sum()), end_id, "<u4")
                begin = np.cumsum(n) - n
                flat[S.ragged(begin, n - 1)] = ids
                per = (n + capacity - 1) // capacity
                doc = np.repeat(np.arange(hi - lo), per)
                piece = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                raw, at = memoryview(flat.tobytes()), begin[doc] + start
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), np.int64, len(doc))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(doc + lo)), pa.array(doc + seen, pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)],
                    ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
                )
                seen += hi - lo

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def fill(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Lengths are 1 to capacity."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    held: dict[int, list[int]] = {}
    for k in order[::-1].tolist():
        held.setdefault(int(lengths[k]), []).append(k)
    left = sorted(held, reverse=True)
    number = 0
    every = (1 << (capacity + 1)) - 1
    while left:
        longest = left[0]
        taken = [longest]
        room = capacity - longest
        goal, reach = 1 << room, 1
        mask = (1 << (room + 1)) - 1 & every
        steps: list[tuple[int, int]] = []  # a length and the sums that were reachable before one more of it
        for length in left:
            if length > room or reach & goal:
                if reach & goal:
                    break
                continue
            for _ in range(min(len(held[length]) - (length == longest), room // length)):
                more = (reach | reach << length) & mask
                if more == reach:
                    break
                steps.append((length, reach))
                reach = more
                if reach & goal:
                    break
        total = reach.bit_length() - 1
        for length, before in reversed(steps):
            if not before >> total & 1:
                taken.append(length)
                total -= length
        at = 0
        for length in taken:
            k = held[length].pop()
            bins[k], offsets[k] = number, at
            at += length
        for length in set(taken):
            if not held[length]:
                del held[length]
                left.remove(length)
        number += 1
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces(). ``cut`` should be cheap to read twice."""
    count = cut.count()
    groups = max(1, -(-count // group))
    schema = f"{', '.join(f.simpleString().replace(':', ' ', 1) for f in cut.schema)}, sequence_id long, offset long"

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).drop_columns("group")
        bins, offsets = fill(table["length"].to_numpy(), capacity)
        return table.append_column("sequence_id", pa.array(bins * groups + key[0].as_py())).append_column("offset", pa.array(offsets))

    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "row", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(packed, schema)
