"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Words are runs of letters, digits and bytes beyond ASCII, and runs of other visible bytes; ASCII is
lower-cased. Features are unigrams and bigrams, hashed to 2**BITS buckets; a bigram of one word twice
is hashed as "the word before again", so that repetition is one feature whatever the word. A feature's
value is SCALE * count / (features of the text + SMOOTH), so a score is one sparse dot product.

Training takes a bounded sample (``per_class`` labelled rows of each label, those whose hash is least,
texts of at most ``train_bytes``), weighted back to the labels' true shares; it runs on the driver over
feature counts. Scoring is a map over whole texts: no shuffle, weights of fixed size (1 MB) broadcast.

Defined cases: null and empty texts have no features and score the bias; labels other than 0 and 1, and
null ids, teach nothing; of several labels of one id the greatest counts; without labels of both kinds
the score is the share of label 1 (0.5 without any); repeated rows each give a row; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docloom.llm import shared as S

BITS, SCALE, SMOOTH = 18, 30.0, 20.0
_AGAIN = np.uint64(0x5851F42D4C957F2D)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the documents, and each document's first (one more than documents)."""
    low = S.LOWER[data]
    visible = S.NOT_SPACE
    kind = np.where(visible, np.where(S.ALNUM | S.byte_set((0x41, 0x5A)), 1, 2), 0).astype(np.int8)[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    change = np.ones(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    change[off[(off > 0) & (off < n)]] = True
    at = np.flatnonzero(change)
    end = np.append(at[1:], n)
    keep = kind[at] > 0
    start, end = at[keep], end[keep]
    word = S.SpanHash(S.BYTE_VALUE[low])(start, end)
    first = np.searchsorted(start, off)
    pair = S.mix(word[:-1] * np.uint64(3) + word[1:])
    pair[word[:-1] == word[1:]] = _AGAIN
    whole = np.ones(max(len(word) - 1, 0), bool)
    inner = first[(first > 0) & (first < len(word))]
    whole[inner - 1] = False
    # a document's bigrams follow each of its words but the last: order by word keeps documents together
    out = np.empty(2 * len(word), np.uint64)
    out[0::2] = word
    out[1:-1:2] = pair
    use = np.ones(2 * len(word), bool)
    use[1:-1:2] = whole
    if len(use):
        use[-1] = False
    before = np.zeros(len(use) + 1, np.int64)
    np.cumsum(use, out=before[1:])
    return (out[use] >> np.uint64(64 - BITS)).astype(np.int64), before[2 * first]


class Ftrl:
    """Per-coordinate FTRL-proximal updates of a logistic regression."""

    def __init__(self, size: int, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, off in S.text_blocks(batch["text"]):
            f, first = features(data, off)
            parts = [np.unique(f[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            sizes = np.array([len(k) for k, _ in parts])
            yield pa.RecordBatch.from_arrays(
                [batch["label"].slice(lo, hi - lo), batch["k"].slice(lo, hi - lo), S.list_column(np.concatenate([k for k, _ in parts]), sizes, pa.int32()), S.list_column(np.concatenate([c for _, c in parts]), sizes, pa.int32())],
                ["label", "k", "at", "n"],
            )


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, train_bytes: int = 65536, epochs: int = 3) -> np.ndarray:
    """Weights by bucket, the bias last. ``labels`` has doc_id and label; rows to hold out must be gone from it."""
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros((1 << BITS) + 1)
    if len(total) < 2:
        weights[-1] = {(): 0.0, (0,): -10.0, (1,): 10.0}[tuple(total)]
        return weights
    picked = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of two numbers: the one side here with a bound of its own
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= train_bytes).join(F.broadcast(picked), "doc_id")
    rows = (
        texts.select(F.col("label").cast("long").alias("label"), F.xxhash64("doc_id", F.lit(7)).alias("k"), "text")
        .mapInArrow(_counted, "label long, k long, at array<int>, n array<int>")
        .toArrow()
    )
    rows = rows.take(np.argsort(rows["k"].to_numpy(), kind="stable"))
    label = rows["label"].to_numpy()
    share = sum(total.values())
    seen = {c: max(1, int((label == c).sum())) for c in (0, 1)}
    weight = {c: total[c] / share * len(label) / seen[c] for c in (0, 1)}
    model = Ftrl((1 << BITS) + 1)
    bias = np.array([1 << BITS], np.int32)
    lists = [(np.append(a.values.to_numpy(), bias), b.values.to_numpy()) for a, b in zip(rows["at"], rows["n"], strict=True)]
    for _ in range(epochs):
        for (at, n), y in zip(lists, label, strict=True):
            model.learn(at, np.append(SCALE * n / (n.sum() + SMOOTH), 1.0), int(y), weight[int(y)])
    return model.weights(slice(None))


def score(docs: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """Adds a score (0 to 1) to any frame with a ``text`` column; map only."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        bias = float(w[-1])
        for batch in batches:
            out = np.empty(batch.num_rows)
            for lo, hi, data, off in S.text_blocks(batch["text"]):
                f, first = features(data, off)
                sums = np.zeros(len(f) + 1)
                np.cumsum(w[f], out=sums[1:], dtype=np.float64)
                n = np.diff(first)
                out[lo:hi] = bias + SCALE * np.diff(sums[first]) / (n + SMOOTH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], [*batch.schema.names, name])

    return docs.mapInArrow(scored, schema)
