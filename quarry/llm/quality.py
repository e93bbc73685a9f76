"""Quality: supervised subword embeddings (hashed words and character n-grams, averaged, softmax), trained by numpy SGD.

A document's features are its words, pairs of neighbouring words and the character n-grams of its whole text, all hashed into one table of vectors; their mean goes through a softmax layer.
Because the layer is linear, softmax(W mean(E)) needs only the scalar (w1 - w0) . E[f] of every bucket at scoring time; that table is what the workers hold, and its size is a parameter.

Defined cases: null and empty texts have no features and get the bias's probability; repeated rows get equal scores; an empty table gives no rows; with no labels the score is 0.5; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bounded_rows, crc_mod, labelled, map_batches, sample_by_hash, tidy
from quarry.llm.kernel import Kernel, ngrams, slices

BITS = 19


def feature_buckets(data: np.ndarray, offsets: np.ndarray, kernel: Kernel, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair of neighbouring words and character n-gram (code points, white space folded), with repeats."""
    rows, buckets = [], []
    if len(data):
        h, first = kernel.word_hashes(data, offsets)
        rows.append(np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first)))
        buckets.append((h >> np.uint64(64 - BITS)).astype(np.int32))
        pairs = ngrams(h, first, 2)
        v, at = kernel.points(data, offsets)
        for row, grams, _ in (pairs, *(ngrams(v, at, n) for n in sizes)):
            rows.append(row)
            buckets.append((grams >> np.uint64(64 - BITS)).astype(np.int32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class QualityModel:
    """table: log-odds of every bucket; the document's log-odds are their mean plus bias."""

    table: np.ndarray
    bias: float
    sizes: tuple[int, ...]

    def score(self, column: pa.Array, kernel: Kernel) -> np.ndarray:
        out = np.zeros(len(column))
        for lo, hi, data, offsets in slices(column):
            rows, buckets = feature_buckets(data, offsets, kernel, self.sizes)
            n = np.bincount(rows, minlength=hi - lo)
            out[lo:hi] = np.bincount(rows, self.table[buckets], hi - lo) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -40, 40)))


def fit_arrays(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, sizes: tuple[int, ...], dim: int = 8, epochs: int = 12, rate: float = 1.0, seed: int = 7) -> QualityModel:
    """docs: (distinct buckets, their shares of the document's features). Plain SGD over documents, the rate falling to 0, errors weighted so that both classes count alike."""
    if not len(y):
        return QualityModel(np.zeros(1 << BITS, np.float32), 0.0, sizes)
    rng = np.random.default_rng(seed)
    used = np.unique(np.concatenate([d[0] for d in docs]))
    place = np.zeros(1 << BITS, np.int64)
    place[used] = np.arange(len(used))
    vectors = rng.uniform(-1 / dim, 1 / dim, (max(1, len(used)), dim)).astype(np.float32)
    layer, bias = rng.uniform(-1, 1, (2, dim)).astype(np.float32), np.zeros(2, np.float32)
    docs = [(place[b], s) for b, s in docs]
    steps, t = epochs * len(docs), 0
    weight = [len(y) / (2 * max(1, int((y == c).sum()))) for c in (0, 1)]  # both classes move the model as far
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, share = docs[i]
            lr = rate * (1 - t / steps)
            t += 1
            mean = share @ vectors[at] if len(at) else np.zeros(dim, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(y[i])] -= 1
            p *= weight[int(y[i])]
            back = layer.T @ p
            layer -= lr * np.outer(p, mean)
            bias -= lr * 0.1 * p
            if len(at):
                # a bucket's share is its step; scaled so that a document moves its mean as far whatever its length
                vectors[at] -= (lr * share / max(float(share @ share), 1e-12) * min(1.0, 16 * float(share @ share)))[:, None] * back
    table = np.zeros(1 << BITS, np.float32)
    table[used] = vectors @ (layer[1] - layer[0])
    return QualityModel(table, float(bias[1] - bias[0]), sizes)


def features(df: DataFrame, text: str, label: str, sizes: tuple[int, ...]) -> DataFrame:
    """(doc_id, label, distinct buckets as int32, counts as int32) of labelled rows."""

    def make():
        kernel = Kernel()

        def step(batch: pa.RecordBatch) -> dict:
            ids, counts = [], []
            for lo, hi, data, offsets in slices(batch[text]):
                rows, buckets = feature_buckets(data, offsets, kernel, sizes)
                pairs, n = np.unique((rows.astype(np.int64) << BITS) | buckets, return_counts=True)
                at = np.searchsorted(pairs >> BITS, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    ids.append((pairs[at[i] : at[i + 1]] & ((1 << BITS) - 1)).astype(np.int32).tobytes())
                    counts.append(n[at[i] : at[i + 1]].astype(np.int32).tobytes())
            return {"doc_id": batch["doc_id"], "label": batch[label].cast(pa.int32()), "buckets": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())}

        return step

    return map_batches(df.select(F.col("doc_id").cast("long").alias("doc_id"), text, label), make, "doc_id long, label int, buckets binary, counts binary")


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", held_out_mod: int = 3, held_out_rest: int = 1, per_class: int = 1200, sizes: tuple[int, ...] = (4, 6), most_bytes: int = 1 << 28) -> QualityModel:
    """Learns from about per_class labelled rows of each class that aren't held out, and from no more of them than have most_bytes of features (the documented bounds). Of several labels of one id 1 wins, of several texts one is taken by hash."""
    known = labelled(labels, label, held_out_mod, held_out_rest)
    chosen = sample_by_hash(known, "y", "doc_id", per_class)
    rows = []
    for r in bounded_rows(features(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "text", "y", sizes), ["buckets", "counts"], most_bytes):
        rows.append((r["label"], r["buckets"], r["counts"]))
    rows.sort()
    docs = [(np.frombuffer(b, np.int32), np.frombuffer(c, np.int32) / np.float32(max(1, np.frombuffer(c, np.int32).sum()))) for _, b, c in rows]
    model = fit_arrays([(b, c.astype(np.float32)) for b, c in docs], np.array([x[0] for x in rows]), sizes)
    del docs, rows
    tidy(documents.sparkSession)
    return model


def score(documents: DataFrame, model: QualityModel, held_out_mod: int = 3, held_out_rest: int = 1) -> DataFrame:
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
