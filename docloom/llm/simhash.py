"""SimHash near-dedup over a Gray-order hierarchical index.

Each whole text gets a 64-bit fingerprint of its three-word shingles (a map). Copies of a fingerprint
fold into one row by a pre-aggregated group. Two fingerprints within three bits agree on one of four
16-bit blocks, so each is dealt to four shards by (block, leading bits of the block); how many leading
bits is set by the number of fingerprints, so that a shard stays near SHARD rows. In a shard, fingerprints
(rotated so that their block leads) are sorted by Gray rank and grouped into a tree whose nodes hold the
bits that all their members share; a search adds up differences on newly shared bits from the root down,
prunes whole groups beyond the threshold, and accepts whole groups that cannot differ by more. A shard
gives each linked fingerprint one link to its local root, never all pairs. Components over those links
come from alternating large-star and small-star rounds, each cut by a checkpoint.

Defined cases: null and empty texts have fingerprint zero and link as any other; a null id stays a row and
counts as no id for a component's least id; repeated rows each give a row; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import shared as S

SHINGLE, SEED, NEAR = 3, 42, 3
BLOCKS = 4
#: Rows of a shard, about.
SHARD = 60_000
#: Children of a node, and queries of a search step.
FAN, STEP = 16, 2048


def fingerprint_block(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of documents."""
    from xxhash import xxh64_intdigest

    low = S.LOWER[data]
    start, end, first = S.words(low, off, S.NOT_SPACE)
    size = end - start
    to = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 32, np.uint8)
    joined[S.ragged(to, size)] = low[S.ragged(start, size)]
    stop = to + size
    n = np.diff(first)
    # a document of n words has n - 2 shingles, one if it has fewer than three words, none without words
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    begin = S.ragged(first[:-1], count)
    last = begin + np.repeat(np.minimum(n, SHINGLE) - 1, count)
    raw = joined.tobytes()
    hashes = np.fromiter((xxh64_intdigest(raw[a:b], SEED) for a, b in zip(to[begin].tolist(), stop[last].tolist(), strict=True)), np.uint64, len(begin))
    out = np.zeros(len(n), np.uint64)
    some = count > 0
    if some.any():
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        at = (np.cumsum(count) - count)[some]
        sums = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * sums > count[some, None], axis=1).view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and fp (the bits as a long) of every row; map only."""
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry), "fp long"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprint_block(data, off) for _, _, data, off in S.text_blocks(batch["text"])]
            fp = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(S.signed(fp))], [*carry, "fp"])

    return docs.select(*carry, "text").mapInArrow(made, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of codes in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """A tree over distinct codes in Gray order; level 0 are the codes, each node above covers FAN below."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        codes = codes[self.order]
        self.values, self.masks = [codes], [np.full(len(codes), 2**64 - 1, np.uint64)]
        self.spans = [1]
        every, some = codes, codes
        while len(every) > FAN:
            at = np.arange(0, len(every), FAN)
            every, some = np.bitwise_and.reduceat(every, at), np.bitwise_or.reduceat(some, at)
            self.values.append(every)
            self.masks.append(~(every ^ some))
            self.spans.append(self.spans[-1] * FAN)

    def linked_groups(self, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(member, first member) for nodes whose members cannot differ by more than ``near`` bits."""
        n = len(self.values[0])
        for mask, span in zip(self.masks[1:], self.spans[1:], strict=True):
            tight = np.flatnonzero(np.bitwise_count(~mask) <= near)
            if len(tight):
                size = np.minimum((tight + 1) * span, n) - tight * span
                yield S.ragged(tight * span, size), np.repeat(tight * span, size)

    def search(self, lo: int, hi: int, near: int, exact: np.uint64, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (code lo..hi, later code or first of an accepted group) within ``near`` bits that agree on ``exact``.

        Nodes all of whose members have the query's root already are passed over.
        """
        codes, n = self.values[0], len(self.values[0])
        query = np.arange(lo, hi)
        top = len(self.values[-1])
        q, node = np.repeat(query, top), np.tile(np.arange(top), len(query))
        spent = np.zeros(len(q), np.int64)
        known = np.zeros(len(q), np.uint64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(len(self.values) - 1, -1, -1):
            span, mask, value = self.spans[level], self.masks[level][node], self.values[level][node]
            differs = (codes[q] ^ value) & mask
            spent = spent + np.bitwise_count(differs & ~known)
            stays = (spent <= near) & (differs & exact == 0) & (np.minimum((node + 1) * span, n) - 1 > q)
            if level:
                at = np.arange(0, n, span)
                least, most = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
                stays &= (least[node] != root[q]) | (most[node] != root[q])
            q, node, spent, mask = q[stays], node[stays], spent[stays], mask[stays]
            if not level:
                out.append((q, node))
                break
            sure = (spent + np.bitwise_count(~mask) <= near) & (~mask & exact == 0)
            out.append((q[sure], node[sure] * span))
            q, node, spent, mask = q[~sure], node[~sure], spent[~sure], mask[~sure]
            below = len(self.values[level - 1])
            size = np.minimum((node + 1) * FAN, below) - node * FAN
            node = S.ragged(node * FAN, size)
            q, spent, known = np.repeat(q, size), np.repeat(spent, size), np.repeat(mask, size)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after the links a-b: least labels spread and are jumped until nothing changes."""
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def shard_links(codes: np.ndarray, near: int, exact_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, position of its root) of codes linked to another one in the shard."""
    index = GrayIndex(codes)
    exact = np.uint64(((1 << exact_bits) - 1) << (64 - exact_bits)) if exact_bits else np.uint64(0)
    root = np.arange(len(codes))
    for member, first in index.linked_groups(near):
        root = _joined(root, member, first)
    for lo in range(0, len(codes), STEP):
        root = _joined(root, *index.search(lo, min(lo + STEP, len(codes)), near, exact, root))
    moved = np.flatnonzero(root != np.arange(len(codes)))
    return index.order[moved], index.order[root[moved]]


def links(fps: DataFrame, near: int = NEAR) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that join all pairs within ``near`` bits."""
    width = 64 // BLOCKS
    if near >= BLOCKS:
        raise ValueError("blocks must outnumber the bits that may differ")
    count = fps.count()
    bits = min(width, max(0, math.ceil(math.log2(max(1, BLOCKS * count / SHARD / BLOCKS)))))

    def found(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy()
        codes = fp.view(np.uint64)
        turn = np.uint64(width * table["block"][0].as_py())
        if turn:
            codes = codes << turn | codes >> (np.uint64(64) - turn)
        a, b = shard_links(codes, near, width)
        return pa.table({"a": fp[a], "b": fp[b]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    turned = F.expr(f"shiftright(fp, {width} * (3 - block))").bitwiseAND((1 << width) - 1)
    dealt = fps.select("fp", F.explode(F.array(*[F.lit(b) for b in range(BLOCKS)])).alias("block")).withColumn("lead", F.shiftright(turned, width - bits))
    return dealt.groupBy("block", "lead").applyInArrow(found, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of the links a-b: alternating large-star and small-star until stable."""
    edges = S.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    while (now := state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every neighbour below, and the node itself, under the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = S.cut(small)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, near: int = NEAR, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, fp, root (a fingerprint that names the component) and component_id (its least id) of every row."""
    marked = S.cut(fingerprints(docs, carry))
    distinct = S.cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), near))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.select("fp", "root").join(ids, "root"), "fp").select(*carry, "fp", "root", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows and columns of the least id (null last; of its texts, one by hash) of each component.

    Of rows that repeat a kept id and text the one whose other columns have the least hash stays. Extra columns of any name are carried.
    """
    h, i, k, o = S.fresh(docs, "_hash", "_id", "_kept", "_other")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    found = near_duplicates(keyed.select("doc_id", h, "text"), carry=("doc_id", h))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", h))
    keep = found.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias(i), F.col(f"k.{h}").alias(k))
    stays = keyed.join(keep, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(k)), "left_semi")
    numbered = stays.withColumn(o, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(F.xxhash64(*docs.columns))))
    return numbered.where(F.col(o) == 1).select(*docs.columns)
