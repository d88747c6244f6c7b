"""Substring dedup: an FM-index over wavelet bits for each shard of repeated segments.

Words are runs of non-space; a window is 13 of them. repeats.py routes segments that can hold a repeated
window to shards. A shard's words become symbols, its suffixes are sorted to the depth of a window, and the
Burrows-Wheeler sequence is kept as a wavelet matrix: one packed bit row a level with sampled ranks. Each
segment streams through the index from right to left: one backward step extends the interval of the last
12 words by the next, a table of 12-word classes drops the word that leaves. Where the matching statistic
reaches the window, the interval's least document decides whether the window starts in an earlier one.

Defined cases: null and empty texts have no words; a null id is before all others; rows with one id are one
document to each other (neither is earlier); repeated rows each give a row; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm import repeats as R
from docloom.llm import shared as S

WINDOW, GRAM = 13, 4


def _split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = S.words(data, off, S.NOT_SPACE)
    return S.SpanHash(S.BYTE_VALUE[data])(start, end), first, start, end


RULES = R.Rules(WINDOW, GRAM, _split, 500_000, False)


class BitRow:
    """Bits with ranks: packed in 64-bit words, one running count for each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, upto: np.ndarray) -> np.ndarray:
        at = upto >> 6
        low = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class FMIndex:
    """Backward search over a sequence of symbols (0 separates) for patterns of at most ``depth`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.depth = depth
        later = lambda r, k: np.append(r[k:], np.zeros(min(k, n), r.dtype))[:n]

        def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b
            return np.unique(key, return_inverse=True)[1].astype(np.int64) + 1

        ranks, have = text.astype(np.int64), 1
        kept = {1: ranks}
        while 2 * have <= depth - 1:
            ranks, have = ranked(ranks, later(ranks, have)), 2 * have
            kept[have] = ranks
        shorter = ranked(ranks, later(ranks, depth - 1 - have)) if depth - 1 > have else ranks
        whole = ranked(ranks, later(ranks, depth - have))
        self.suffixes = np.argsort(whole, kind="stable")
        in_order = whole[self.suffixes]
        self.class_first = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1])) if n else np.zeros(0, np.int64)
        self.class_of = np.cumsum(np.append(True, in_order[1:] != in_order[:-1])) - 1 if n else np.zeros(0, np.int64)
        in_order = shorter[self.suffixes]
        first = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(first, n))
        self.short_lo, self.short_hi = np.repeat(first, size), np.repeat(first + size, size)
        last = text[self.suffixes - 1]
        self.symbols = int(text.max(initial=0)) + 1
        self.starts = np.zeros(self.symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.symbols), out=self.starts[1:])
        self.levels: list[tuple[BitRow, int]] = []
        row = last
        self.bits = max(1, (self.symbols - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level & 1).astype(bool)
            self.levels.append((BitRow(bit), int(len(bit) - bit.sum())))
            row = np.concatenate([row[~bit], row[bit]])
        every = np.arange(self.symbols)
        self.base = self._walk(every, np.zeros(self.symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (row, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = row.ones(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one symbol put before them."""
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) - np.concatenate([self.base[symbol]] * 2) + np.concatenate([self.starts[symbol]] * 2)
        return both[: len(lo)], both[len(lo) :]

    def search(self, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the windows of ``depth`` symbols at the starts; empty ones have lo >= hi."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.suffixes))
        for k in range(self.depth - 1, -1, -1):
            lo, hi = self.extend(text[start + k], lo, hi)
        return lo, hi

    def stream(self, text: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The class (of equal windows) of each window of each run of windows first..first+count, -1 where absent.

        All runs move left together, each by its last interval where it has one.
        """
        where = np.cumsum(count) - count
        out = np.full(int(count.sum()), -1, np.int64)
        runs = np.argsort(-count, kind="stable")
        lo, hi = self.search(text, (first + count - 1)[runs])
        step = 1
        while len(runs):
            found = lo < hi
            out[(where + count - step)[runs[found]]] = self.class_of[lo[found]]
            step += 1
            on = count[runs] >= step
            runs, lo, hi = runs[on], lo[on], hi[on]
            start = (first + count - step)[runs]
            found = lo < hi
            at = lo[found]
            lo[found], hi[found] = self.extend(text[start[found]], self.short_lo[at], self.short_hi[at])
            lo[~found], hi[~found] = self.search(text, start[~found])
        return out


def shard(table: pa.Table) -> pa.Table:
    """Windows that start in no earlier document, of a shard in order of (id, start)."""
    _, values, first, segment, place = R.windows_of(table, RULES)
    symbol = np.unique(values, return_inverse=True)[1].astype(np.int64) + 1
    count = table["windows"].to_numpy().astype(np.int64)
    length = count + WINDOW - 1
    begin = first[:-1]
    text = np.zeros(len(symbol) + len(count), np.int64)
    moved = begin + np.arange(len(count))
    text[S.ragged(moved, length)] = symbol
    index = FMIndex(text, WINDOW)
    ids = table["id"].to_numpy()
    owner = np.append(np.repeat(np.arange(len(count)), length + 1), 0)[: len(text)]
    least = np.minimum.reduceat(ids[owner[index.suffixes]], index.class_first)
    classes = index.stream(text, moved, count)
    return R.kept_table(table, first, segment, place, (classes < 0) | (least[classes] >= ids[segment]))


def _report(data: np.ndarray, off: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> list[pa.Array]:
    n = np.diff(first)
    keep = np.flatnonzero(~gone)
    kept = np.searchsorted(keep, first)
    length = end[keep] - start[keep] + 1
    to = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(length, out=to[1:])
    flat = np.full(int(to[-1]), 32, np.uint8)
    flat[S.ragged(to[:-1], length - 1)] = data[S.ragged(start[keep], length - 1)]
    a, b = to[kept[:-1]], np.maximum(to[kept[1:]] - 1, to[kept[:-1]])
    texts = [flat[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    digests = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
    return [pa.array(n), pa.array(n - np.diff(kept)), digests, pa.array(texts, pa.binary()).cast(pa.string())]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by spaces) digest and text of every row."""
    return R.without_repeats(docs, RULES, shard, _report, "n_words long, n_removed long, kept_sha256 string, kept string")
