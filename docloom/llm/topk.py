"""Exact top-k by inner product with pivot-table elimination.

Queries and candidates are dealt to blocks, and each pair of blocks is one task of bounded size; blocks
multiply with the data, their sizes do not. A task holds a table of its candidates' distances to the
pivots. For a query, |d(q,p) - d(x,p)| over all pivots p gives the greatest lower bound of d(q,x), and
so, with both norms, an upper bound of the inner product; candidates are evaluated in the order of that
bound until no later one can reach the tenth best. Tasks return k rows a query, which a ranked window merges.

Pivots come from a bounded sample (PIVOT_SAMPLE rows of least hash), spread out farthest-first; any choice
gives the same result.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take
no part; vectors of unequal length compare as if padded with zeros; repeated rows are candidates each (not
of their own id), and as queries each have their own k best; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import shared as S

PIVOTS, PIVOT_SAMPLE = 24, 256
CANDIDATES, QUERIES = 8192, 1024
_ROW = "p int, q int, vec_id long, v array<long>"


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    rows = table["v"].combine_chunks()
    off = rows.offsets.to_numpy().astype(np.int64)
    n = np.diff(off)
    out = np.zeros((len(n), width), np.int64)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.arange(len(n)) * width, n)
    out.ravel()[place] = rows.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    x = sample.astype(float)
    picked = [0]
    near = np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(count, len(x)):
        picked.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[picked[-1]], axis=1))
    return sample[picked]


def search_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, pivots: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the indices of its k best rows (score downwards, then id), without rows of its own id."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    x, q, p = rows.astype(float), queries.astype(float), pivots.astype(float)
    size = max(1.0, np.abs(x).max(initial=0.0)) * max(1.0, np.abs(q).max(initial=0.0)) * x.shape[1]
    exact = size < 2**52  # then double arithmetic holds all sums exactly
    to_pivots = np.sqrt(np.maximum(((x[:, None, :] - p[None]) ** 2).sum(axis=2), 0)) if len(x) * len(p) * x.shape[1] < 1 << 24 else np.stack([np.linalg.norm(x - v, axis=1) for v in p], axis=1)
    norms = (x * x).sum(axis=1)
    slack = 1e-6 * max(1.0, size)
    out = []
    for vector, whole, own in zip(q, queries, query_ids, strict=True):
        from_query = np.linalg.norm(p - vector, axis=1)
        lower = np.abs(to_pivots - from_query).max(axis=1) if len(p) else np.zeros(len(x))
        upper = (vector @ vector + norms - lower * lower) / 2 + slack
        upper[ids == own] = -np.inf
        by_bound = np.argsort(-upper, kind="stable")
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step = 0, 64
        while at < len(by_bound):
            part = by_bound[at : at + step]
            part = part[upper[part] > -np.inf]
            if not len(part) or len(best) == k and upper[part[0]] < scores[-1]:
                break
            got = (x[part] @ vector).astype(np.int64) if exact else rows[part] @ whole
            best, scores = np.concatenate([best, part]), np.concatenate([scores, got])
            keep = np.lexsort((best, -scores))[:k]  # rows are in the order of ids
            best, scores = best[keep], scores[keep]
            at, step = at + step, 2 * step
        out.append(order[best])
    return out


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score over rows with vec_id and v (array of long, not null); ``is_query`` is a condition.

    Rows that repeat an id are queries of their own, each with its k best, and are no candidates of one another.
    """
    spark = vectors.sparkSession
    width, total, asked = vectors.agg(F.max(F.size("v")), F.count("*"), F.count(F.when(is_query, 1))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    parts, groups = math.ceil(total / CANDIDATES), math.ceil(asked / QUERIES)
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOT_SAMPLE).toArrow()
    pivots = choose_pivots(_matrix(sample, width), PIVOTS)
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select(block(parts, 1).alias("p"), "vec_id", "v").select("p", every(groups).alias("q"), "vec_id", "v")
    # the tag tells queries of one id apart; it is cut so that a lost task makes the same one again
    tagged = S.cut(vectors.where(is_query).select(F.monotonically_increasing_id().alias("tag"), "vec_id", "v"))
    asks = tagged.select(block(groups, 2).alias("q"), "tag", "vec_id", "v").select(every(parts).alias("p"), "q", "tag", "vec_id", "v")

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        asked_ids, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        queries, x = _matrix(left, width), _matrix(right, width)
        found = search_block(queries, asked_ids, x, ids, pivots, k) if len(left) and len(right) else []
        n = np.array([len(f) for f in found], np.int64)
        q = np.repeat(np.arange(len(found)), n)
        hit = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        return pa.table({"query_id": asked_ids[q], "tag": left["tag"].to_numpy()[q], "vec_id": ids[hit], "score": (queries[q] * x[hit]).sum(axis=1).astype(np.int64)})

    best = asks.groupBy("p", "q").cogroup(rows.groupBy("p", "q")).applyInArrow(searched, "query_id long, tag long, vec_id long, score long")
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(rows: DataFrame, factor: int = 1024) -> DataFrame:
    """vec_id, v (floor of factor * component) of the rows that take part."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * factor)).alias("v")
    )
