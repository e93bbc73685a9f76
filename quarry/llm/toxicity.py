"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the distinct hashed character n-grams of its whole text (A-Z lower-cased, any run of white space is one space).
Training: the log-count ratio r of every bucket is taken over a bounded, hash-chosen sample of labelled rows; the buckets of greatest evidence are kept, and a logistic regression over x * r is fitted in numpy.
Scoring: a gather and a per-document sum in the workers; no shuffle, the model is of fixed size.

Defined cases: null and empty texts have no features and get the model's bias as score; repeated rows get equal scores; an empty table gives no rows; with no labels or one class the score is that class's share (0.5 without labels); other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_rows, crc_mod, filter_batches, labelled, map_batches, sample_by_hash, tidy
from quarry.llm.kernel import Kernel, ngrams, slices

BUCKET_BITS = 20


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, kernel: Kernel, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram (code points, white space folded), with repeats."""
    v, at = kernel.points(data, offsets)
    parts = [ngrams(v, at, n)[:2] for n in sizes]
    return np.concatenate([r for r, _ in parts]), np.concatenate([(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) for _, h in parts])


@dataclass
class ToxicityModel:
    """weights: by bucket, 0 for buckets left out; sizes: n-gram lengths in characters."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    def score(self, column: pa.Array, kernel: Kernel) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for lo, hi, data, offsets in slices(column, 1 << 19):
            rows, buckets = ngram_buckets(data, offsets, kernel, self.sizes)
            w = self.weights[buckets]
            hit = np.flatnonzero(w)
            pairs = np.unique((rows[hit].astype(np.int64) << BUCKET_BITS) | buckets[hit])  # presence, not counts
            out[lo:hi] += np.bincount(pairs >> BUCKET_BITS, self.weights[pairs & ((1 << BUCKET_BITS) - 1)], hi - lo)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit_arrays(docs: list[np.ndarray], y: np.ndarray, sizes: tuple[int, ...], keep: int = 1 << 14, alpha: float = 1.0, l2: float = 1e-3, steps: int = 300) -> ToxicityModel:
    """Fits on distinct buckets of each document. Both classes weigh alike, whatever their numbers in the sample: the threshold doesn't move with the size of the table."""
    m = 1 << BUCKET_BITS
    weights = np.zeros(m, np.float32)
    if not len(y):
        return ToxicityModel(weights, 0.0, sizes)
    share = float(y.mean())
    if not 0 < share < 1:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return ToxicityModel(weights, float(np.log(share / (1 - share))), sizes)
    counted = lambda own: np.bincount(np.concatenate([d for d, t in zip(docs, y) if t == own]), minlength=m).astype(float)
    pos, neg = counted(1), counted(0)
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    p, q = (pos + alpha) / (n1 + 2 * alpha), (neg + alpha) / (n0 + 2 * alpha)  # document frequencies of presence
    ratio = np.log(p / q)
    # evidence: how unlikely the ratio is by chance, a z-score of the two document frequencies
    pool = (pos + neg + 2 * alpha) / (n1 + n0 + 4 * alpha)
    z = np.abs(p - q) / np.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0) + 1e-12)
    z[(pos + neg) < 3] = 0
    chosen = np.argsort(-z, kind="stable")[:keep]
    chosen = chosen[z[chosen] > 3.0]
    if not len(chosen):
        return ToxicityModel(weights, float(np.log(share / (1 - share))), sizes)
    place = np.full(m, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    kept = [p[p >= 0] for p in (place[d] for d in docs)]  # only the chosen buckets of each document
    r, c = np.repeat(np.arange(len(docs)), [len(k) for k in kept]), np.concatenate(kept)
    x = ratio[chosen][c]
    each = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    beta, bias = np.zeros(len(chosen)), 0.0
    # each document's features are weighted as x * r; Adam on the full batch
    m1, m2, b1, b2 = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0.9, 0.999
    for t in range(1, steps + 1):
        logit = bias + np.bincount(r, x * beta[c], len(docs))
        g = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * each
        grad = np.append(np.bincount(c, x * g[r], len(chosen)) / len(docs) + l2 * beta, g.mean())
        m1, m2 = b1 * m1 + (1 - b1) * grad, b2 * m2 + (1 - b2) * grad * grad
        step = 0.05 * (m1 / (1 - b1**t)) / (np.sqrt(m2 / (1 - b2**t)) + 1e-8)
        beta, bias = beta - step[:-1], bias - step[-1]
    weights[chosen] = beta * ratio[chosen]
    return ToxicityModel(weights, float(bias), sizes)


def features(df: DataFrame, text: str, label: str, sizes: tuple[int, ...]) -> DataFrame:
    """(doc_id, label, distinct buckets as little-endian int32) of labelled rows."""

    def make():
        kernel = Kernel()

        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for lo, hi, data, offsets in slices(batch[text], 1 << 19):
                rows, buckets = ngram_buckets(data, offsets, kernel, sizes)
                pairs = np.unique((rows.astype(np.int64) << BUCKET_BITS) | buckets)
                at = np.searchsorted(pairs >> BUCKET_BITS, np.arange(hi - lo + 1))
                out += [(pairs[at[i] : at[i + 1]] & ((1 << BUCKET_BITS) - 1)).astype(np.int32).tobytes() for i in range(hi - lo)]
            return {"doc_id": batch["doc_id"], "label": batch[label].cast(pa.int32()), "buckets": pa.array(out, pa.binary())}

        return step

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), text, label), make, "doc_id long, label int, buckets binary")


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", held_out_mod: int = 5, held_out_rest: int = 0, per_class: int = 1500, sizes: tuple[int, ...] = (4, 6), most_bytes: int = 1 << 28) -> ToxicityModel:
    """Learns from about per_class labelled rows of each class that aren't held out, and from no more of them than have most_bytes of features (the documented bounds). Of several labels of one id 1 wins, of several texts one is taken by hash."""
    known = labelled(labels, label, held_out_mod, held_out_rest)
    chosen = sample_by_hash(known, "y", "doc_id", per_class)
    rows = features(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "text", "y", sizes)  # at most about 2 * per_class ids
    docs, y = [], []
    for r in bounded_rows(rows, ["buckets"], most_bytes):
        docs.append(np.frombuffer(r["buckets"], np.int32))
        y.append(r["label"])
    if not docs:
        return fit_arrays([], np.zeros(0), sizes)
    order = sorted(range(len(docs)), key=lambda i: (y[i], docs[i].tobytes()))  # the same model whatever the partitioning
    model = fit_arrays([docs[i] for i in order], np.array([y[i] for i in order], dtype=float), sizes)
    del docs, r
    tidy(documents.sparkSession)
    return model


def score(documents: DataFrame, model: ToxicityModel, held_out_mod: int = 5, held_out_rest: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        kernel = Kernel()

        def step(batch: pa.RecordBatch) -> dict:
            s = shared.value.score(batch["text"], kernel)
            return {"doc_id": batch["doc_id"], "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}

        return step

    out = map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double, predicted int")
    return out.select("doc_id", (crc_mod("doc_id", held_out_mod) == held_out_rest).alias("held_out"), "score", "predicted")


def reject(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows, whole, whose score is under 0.5."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        kernel = Kernel()
        return lambda batch: shared.value.score(batch["text"], kernel) < 0.5

    return filter_batches(documents, make)
