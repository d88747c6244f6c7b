"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

A text is cut into segments of SPAN bytes; in each, one recurrence runs forward and one backward over
all bytes, and a softmax of both states labels every position. A document's probabilities are the means
over its positions. Training is backpropagation through time with Adam on a bounded sample: for each
language at most ``per_lang`` documents (those whose hash is least, texts of at most ``train_bytes``;
where a language has none of these, the beginnings of its longer ones) and STEPS batches of segments.

Prediction is a map over whole texts without a shuffle; the network (a few tens of KB) is broadcast.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows without language or
id teach nothing; without any language to learn every text is ``und``; repeated rows each give a row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from docloom.llm import shared as S

SPAN, HIDDEN, STEPS, BATCH = 64, 8, 260, 192
#: Segments that prediction takes at once; bounds the memory of a task.
WIDE = 4096


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SPAN, segments) bytes, zero where a document has ended; bytes in each segment; each document's first segment."""
    length = np.diff(off)
    per = (length + SPAN - 1) // SPAN
    first = np.zeros(len(off), np.int64)
    np.cumsum(per, out=first[1:])
    flat = np.zeros(int(first[-1]) * SPAN, np.uint8)
    flat[S.ragged(first[:-1] * SPAN, length)] = data
    used = np.full(int(first[-1]), SPAN, np.int64)
    some = per > 0
    used[first[1:][some] - 1] = length[some] - (per[some] - 1) * SPAN
    return np.ascontiguousarray(flat.reshape(-1, SPAN).T), used, first


class Network:
    """Weights by name: for each direction E (bytes to gates), U (state to gates), b; V and c for the labels.

    Gates are rows z, r (HIDDEN each, kept as tanh of half the value) and the candidate.
    """

    def __init__(self, langs: list[str], seed: int = 7):
        rng, h, n = np.random.default_rng(seed), HIDDEN, len(langs)
        self.langs = langs
        self.w = {}
        for d in "fb":
            self.w[f"E{d}"] = rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.w[f"U{d}"] = rng.normal(0, 0.3, (3 * h, h)).astype(np.float32)
            self.w[f"b{d}"] = np.zeros((h, 1), np.float32)
            self.w[f"V{d}"] = rng.normal(0, 0.3, (n, h)).astype(np.float32)
        self.w["c"] = np.zeros((n, 1), np.float32)

    def _run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        h, w = HIDDEN, self.w
        E, U, b = w[f"E{d}"], w[f"U{d}"], w[f"b{d}"]
        m = x.shape[1]
        state = np.zeros((h, m), np.float32)
        states = np.empty((SPAN, h, m), np.float32)
        trace = []
        for t in range(SPAN) if d == "f" else range(SPAN - 1, -1, -1):
            e = np.take(E, x[t], axis=1, mode="clip")
            a = U @ state
            gate = e[: 2 * h]
            gate += a[: 2 * h]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            inner = a[2 * h :] + b
            cand = e[2 * h :]
            cand += gate[h:] * inner
            np.tanh(cand, out=cand)
            z = gate[:h]
            new = state - cand
            new *= z
            new += cand
            if keep:
                trace.append((t, state, gate, inner, cand))
            state = new
            states[t] = state
        return states, trace

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (SPAN, languages, segments) of every position."""
        x = x.astype(np.intp)
        out = np.matmul(self.w["Vf"], self._run("f", x, False)[0])
        out += np.matmul(self.w["Vb"], self._run("b", x, False)[0])
        out += self.w["c"]
        np.exp(out, out=out)  # states are within -1 and 1, so logits are small
        out /= out.sum(axis=1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, used: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        h, w = HIDDEN, self.w
        runs = {d: self._run(d, x, True) for d in "fb"}
        logits = np.matmul(w["Vf"], runs["f"][0]) + np.matmul(w["Vb"], runs["b"][0]) + w["c"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        real = (np.arange(SPAN)[:, None] < used[None, :]).astype(np.float32)
        total = real.sum()
        each = np.take_along_axis(p, np.broadcast_to(y[None, None, :], (SPAN, 1, len(y))), 1)[:, 0]
        loss = float(-(np.log(each + 1e-9) * real).sum() / total)
        g = p
        g[:, y, np.arange(len(y))] -= 1
        g *= (real / total)[:, None, :]
        out = {"c": g.sum(axis=(0, 2))[:, None]}
        for d in "fb":
            states, trace = runs[d]
            out[f"V{d}"] = np.einsum("tlm,thm->lh", g, states, optimize=True)
            from_labels = np.matmul(w[f"V{d}"].T, g)
            dU, db, dE = np.zeros_like(w[f"U{d}"]), np.zeros_like(w[f"b{d}"]), np.zeros((256, 3 * h), np.float32)
            back = np.zeros((h, x.shape[1]), np.float32)
            for t, state, gate, inner, cand in reversed(trace):
                back = back + from_labels[t]
                z, r = gate[:h], gate[h:]
                d_cand = back * (1 - z) * (1 - cand * cand)
                d_inner = d_cand * r
                # gates are 0.5 + 0.5 tanh(u): the slope in u is 2 s (1 - s)
                d_gate = np.concatenate([back * (state - cand), d_cand * inner]) * (2 * gate * (1 - gate))
                d_a = np.concatenate([d_gate, d_inner])
                dU += d_a @ state.T
                db += d_inner.sum(axis=1, keepdims=True)
                np.add.at(dE, x[t], np.concatenate([d_gate, d_cand]).T)
                back = back * z + w[f"U{d}"].T @ d_a
            out[f"U{d}"], out[f"b{d}"], out[f"E{d}"] = dU, db, dE.T
        return loss, out

    def fit(self, x: np.ndarray, used: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam over batches that hold all languages alike."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(v) for k, v in self.w.items()}
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        by = [b for b in by if len(b)]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, max(1, BATCH // len(by))) for b in by])
            _, grads = self.gradients(x[:, pick], used[pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            rate = 0.02 * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                g = g / max(1.0, norm)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)

    def documents(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities (documents, languages)."""
        x, used, first = segments(data, off)
        n = x.shape[1]
        sums = np.zeros((n + 1, len(self.langs)))
        for lo in range(0, n, WIDE):
            p = self.label(x[:, lo : lo + WIDE])
            short = used[lo : lo + WIDE]
            for k in np.flatnonzero(short < SPAN):
                p[short[k] :, :, k] = 0
            sums[lo + 1 : lo + 1 + p.shape[2]] = p.sum(axis=0).T
        np.cumsum(sums, axis=0, out=sums)
        return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(off), 1)[:, None]


def train(docs: DataFrame, per_lang: int = 150, train_bytes: int = 65536) -> Network:
    """Fits a network on rows with doc_id, text and lang; rows to hold out must be gone from them."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").select("doc_id", "lang", "text", (F.octet_length("text") <= train_bytes).alias("short"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("all"), F.count_if("short").alias("short")).collect()
    # a language without a shorter text is learned from the beginnings of its long ones
    long_ones = [r["lang"] for r in sizes if not r["short"]]
    counts = [{"lang": r["lang"], "count": r["short"] or r["all"]} for r in sizes]
    known = known.where(F.col("short") | F.col("lang").isin(long_ones) if long_ones else F.col("short"))
    known = known.withColumn("text", F.when(F.col("short"), F.col("text")).otherwise(F.substring("text", 1, train_bytes // 4)))
    langs = sorted(r["lang"] for r in counts)
    network = Network(langs)
    if not langs:
        return network
    # a hash threshold picks about twice the rows that are needed before any are ordered
    share = {r["lang"]: min(1.0, (2 * per_lang + 20) / r["count"]) for r in counts}
    limit = F.element_at(F.create_map(*[F.lit(v) for kv in share.items() for v in kv]), F.col("lang"))
    rank = F.xxhash64("doc_id", F.lit(3))
    near = known.where(F.col("lang").isin(langs)).where(F.pmod(rank, F.lit(1 << 30)) < limit * (1 << 30)).select("lang", "text", rank.alias("rank"))
    rows = near.orderBy("rank", "text").limit(len(langs) * (3 * per_lang + 60)).toArrow()
    order: dict[str, int] = {}
    keep = []
    for k, lang in enumerate(rows["lang"].to_pylist()):
        order[lang] = order.get(lang, 0) + 1
        if order[lang] <= per_lang:
            keep.append(k)
    rows = rows.take(keep).combine_chunks()
    data, off = S.utf8(rows["text"].combine_chunks() if isinstance(rows["text"], pa.ChunkedArray) else rows["text"])
    x, used, first = segments(data, off)
    y = np.repeat(np.array([langs.index(v) for v in rows["lang"].to_pylist()]), np.diff(first))
    network.fit(x, used, y)
    return network


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """Adds lang_pred and lang_score to any frame with a ``text`` column; map only."""
    shipped = docs.sparkSession.sparkContext.broadcast((network.langs, network.w))
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w = shipped.value
        net = Network(langs)
        net.w = w
        names = np.array([*langs, "und"], object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            if langs:
                for lo, hi, data, off in S.text_blocks(batch["text"]):
                    p = net.documents(data, off)
                    best[lo:hi], score[lo:hi] = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "lang_score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return (
        docs.mapInArrow(labelled, schema)
        .withColumn("lang_score", F.when(letters, F.col("lang_score")).otherwise(F.lit(0.0)))
        .withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise(F.lit("und")))
    )
