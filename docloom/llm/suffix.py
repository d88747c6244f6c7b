"""Suffix-array dedup: blockwise construction with a difference cover.

A window is 100 bytes. repeats.py routes segments that can hold a repeated window to shards. In a shard the
suffixes at positions of a difference cover modulo 7 (residues 0, 1, 3) get ranks by doubling, 3/7 of all.
The suffix array is then made one bucket (first byte) at a time, so that only a bucket's keys are in memory:
suffixes are sorted by their first 7 bytes, and those that tie are ordered by the cover's ranks, as any two
suffixes have an offset below 7 that brings both to covered positions. Neighbours whose first 100 bytes
agree are one class; all of a class but its first occurrence are repeated.

Defined cases: null texts are empty; a null id is before all others; rows with one id are one document
(earlier starts come first, a repeated row gives the same result again); extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm import repeats as R
from docloom.llm import shared as S

WINDOW, GRAM = 100, 32
PERIOD, COVER = 7, (0, 1, 3)



def _split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    every = np.arange(len(data) + 1)
    return S.BYTE_VALUE[data], off, every[:-1], every[1:]


RULES = R.Rules(WINDOW, GRAM, _split, 1_500_000, True)

#: For residues a and b, the least offset that brings both into the cover.
MEET = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def leading(data: np.ndarray, width: int) -> np.ndarray:
    """The next ``width`` (at most 8) bytes of each position as a number, zeros after the end."""
    out = np.zeros(len(data), np.uint64)
    padded = np.append(data, np.zeros(width, np.uint8))
    for k in range(width):
        out = out << np.uint64(8) | padded[k : k + len(data)].astype(np.uint64)
    return out


def cover_ranks(data: np.ndarray, seven: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the suffix at each covered position by at least ``depth`` bytes, 0 elsewhere and after the end."""
    n = len(data)
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    ranks = np.zeros(n + 8 * depth + PERIOD, np.int32)
    ranks[at] = np.unique(seven[at], return_inverse=True)[1] + 1
    have = PERIOD
    while have < depth:
        key = ranks[at].astype(np.int64) << 32 | ranks[at + have]
        ranks[at] = np.unique(key, return_inverse=True)[1] + 1
        have *= 2
    return ranks


def bucket_order(at: np.ndarray, seven: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Suffix positions of one bucket in order."""
    at = at[np.argsort(seven[at], kind="stable")]
    key = seven[at]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    tied = np.repeat(size > 1, size)
    t = np.flatnonzero(tied)
    if not len(t):
        return at
    position, group = at[t], (np.cumsum(new) - 1)[t]
    base = first[group]
    residue = position % PERIOD
    members = [np.flatnonzero(residue == a) for a in range(PERIOD)]
    place = np.zeros(len(t), np.int64)
    compared = lambda rows, d: group[rows].astype(np.int64) << 32 | ranks[position[rows] + d]
    for b in range(PERIOD):
        if not len(members[b]):
            continue
        for d in np.unique(MEET[:, b]).tolist():
            there = np.sort(compared(members[b], d))
            for a in np.flatnonzero(MEET[:, b] == d).tolist():
                rows = members[a]
                if len(rows):
                    here = compared(rows, d)
                    place[rows] += np.searchsorted(there, here) - np.searchsorted(there, group[rows].astype(np.int64) << 32)
    # equal to the depth of the ranks: any order among them will do, and the stable sort keeps positions
    order = np.lexsort((position, base + place))
    out = at.copy()
    out[t] = position[order]
    return out


def same_start(eight: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the first ``depth`` bytes at a and b agree; both have as many. ``eight`` has the next 8 bytes of each position."""
    out = np.ones(len(a), bool)
    alive = np.arange(len(a))
    for k in [*range(0, depth - 7, 8), depth - 8]:
        alive = alive[eight[a[alive] + k] == eight[b[alive] + k]]
    out[:] = False
    out[alive] = True
    return out


def repeated_windows(data: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Flags of window starts (sorted) whose window has an earlier equal among them."""
    seven, eight = leading(data, PERIOD), leading(data, 8)
    ranks = cover_ranks(data, seven, window)
    gone = np.zeros(len(data), bool)
    head = data[at]
    for value in np.unique(head).tolist():
        suffixes = bucket_order(at[head == value], seven, ranks)
        if len(suffixes) < 2:
            continue
        new = np.append(True, ~same_start(eight, suffixes[:-1], suffixes[1:], window))
        least = np.minimum.reduceat(suffixes, np.flatnonzero(new))
        gone[suffixes] = suffixes != least[np.cumsum(new) - 1]
    return gone[at]


def shard(table: pa.Table) -> pa.Table:
    """Windows that do not occur before, of a shard in order of (id, start)."""
    data, _, first, segment, place = R.windows_of(table, RULES)
    return R.kept_table(table, first, segment, place, ~repeated_windows(data, place, WINDOW))


def _report(data: np.ndarray, off: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> list[pa.Array]:
    n = np.diff(off)
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edge = off[(off > 0) & (off < len(data))]
    begins[edge] = gone[edge]
    runs, left = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=runs[1:])
    np.cumsum(~gone, out=left[1:])
    flat = data[~gone]
    kept = left[off]
    texts = [flat[a:b].tobytes() for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
    digests = pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
    return [pa.array(n), pa.array(n - np.diff(kept)), pa.array(np.diff(runs[off])), digests, pa.array(texts, pa.binary())]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every row."""
    return R.without_repeats(docs, RULES, shard, _report, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
