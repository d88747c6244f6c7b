"""What the operators of this subpackage share: checkpoints, Arrow text access, vectorised hashing.

Texts reach Python as Arrow columns and are worked on as one byte array with document offsets, in blocks of
bounded size. Where an operator still has an interpreter step per row or per word, it says so.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task holds in numpy form at once (a longer document is one block).
BLOCK_BYTES = 1 << 19
#: Stands for a null document id in comparisons: before every other id.
NULL_ID = -(1 << 63)

#: Bytes of an Arrow batch between the JVM and Python, where the session sets none: rows of long texts come in smaller numbers.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: dict[str, str] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's limit of Arrow batches in bytes, unless it has one."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, but only for a local master, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _made:
            _made[app] = tempfile.mkdtemp(prefix="docloom-")
        where = _made[app]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder; Spark removes the files with the frame."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: compressed, columnar, kept when executors go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files behind a frame of written()."""
    jvm = df.sparkSession._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of the given ones that the frame does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str, by: int):
    """crc32 of a column as text, modulo by; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


# ---------------------------------------------------------------- Arrow text


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay within the limit, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of a column."""
    data, off = utf8(column)
    for lo, hi in blocks(off, limit):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15
#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class SpanHash:
    """Hashes of any spans of a sequence of 64-bit values in constant time each."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def fixed(self, k: int) -> np.ndarray:
        """Hashes of all spans of length k, by start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + np.uint64(k * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags with the ranges (both ends included) set."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Bytes of words that end at ASCII white space only, and of words of ASCII letters, digits and all else beyond ASCII.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all documents, and each document's first word (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    flag = inside[data]
    first = flag.copy()
    first[1:] &= ~flag[:-1]
    edge = off[(off > 0) & (off < n)]
    first[edge] = flag[edge]
    last = flag.copy()
    last[:-1] &= ~flag[1:]
    last[edge - 1] = flag[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All indices start..start+length of each range, one range after the other."""
    total = int(length.sum())
    out = np.ones(total, np.int64)
    keep = length > 0
    start, length = start[keep].astype(np.int64), length[keep].astype(np.int64)
    if not total:
        return out
    out[0] = start[0]
    at = np.cumsum(length)[:-1]
    out[at] = start[1:] - (start[:-1] + length[:-1] - 1)
    return np.cumsum(out)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each row's list."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by start, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class HashTable:
    """Distinct 64-bit keys to their numbers in order of arrival; open addressing, all keys of a call at once."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.keys, self.index = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers, -1 for keys that are not there."""
        at = self._slot(keys)
        out = self.index[at]
        more = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        out[more] = -1
        at = at[more]
        while len(more):
            at = (at + 1) & ((1 << self.bits) - 1)
            number = self.index[at]
            hit = (number >= 0) & (self.keys[at] == keys[more])
            out[more[hit]] = number[hit]
            on = ~hit & (number >= 0)
            more, at = more[on], at[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Adds distinct keys that are not there yet; they get the next numbers in their order."""
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # each round, the first of those that want a free slot gets it
            free = self.index[at] < 0
            got = np.zeros(len(todo), bool)
            got[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
            got &= free
            self.keys[at[got]], self.index[at[got]] = keys[todo[got]], self.size + todo[got]
            todo, at = todo[~got], (at[~got] + 1) & ((1 << self.bits) - 1)
        self.size += len(keys)
