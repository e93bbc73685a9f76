"""Document fingerprints by one-permutation MinHash with optimal densification and packed low-order bits.

Every five-word shingle (A-Z lower-cased) is hashed once: the top 8 bits choose one of 256 bins, a bin keeps its minimum. An empty bin takes the minimum of another bin, the first filled one in an order that is drawn at random for each bin and is the same for all documents. Of each minimum (mixed) the low 8 bits are kept; a fingerprint is 256 bytes in hexadecimal.
The likeness of two fingerprints is the share of equal bytes, corrected for equality by chance.

Defined cases: a text without words (null and empty too) has the empty fingerprint '', which is 1 like itself and 0 like any other; texts of fewer than five words are one shingle; equal texts have equal fingerprints. Rows that repeat a doc_id are ordered by text; rows without a doc_id come last. In a table of one row the next document is the row itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.kernel import Kernel, mix, shingles, slices
from quarry.llm.ordered import bounds, bucket, spread

BINS = 256


class Fingerprinter:
    """Per task: the kernel and the bins' search orders."""

    def __init__(self) -> None:
        self.kernel = Kernel()
        rank = np.random.default_rng(20240229).random((BINS, BINS)).argsort(1).argsort(1)
        self.rank = rank.astype(np.int16)  # rank[i, j]: how late bin j comes in bin i's order

    def sets(self, hashes: np.ndarray) -> bytes:
        """Fingerprint of one document's shingle hashes (repeats allowed)."""
        if not len(hashes):
            return b""
        h = np.sort(hashes)
        of = (h >> np.uint64(56)).astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = of[1:] != of[:-1]
        full = of[new]
        low = np.zeros(BINS, np.uint8)
        low[full] = (mix(h[new]) & np.uint64(255)).astype(np.uint8)
        if len(full) < BINS:
            empty = np.ones(BINS, bool)
            empty[full] = False
            empty = np.flatnonzero(empty)
            low[empty] = low[full[self.rank[np.ix_(empty, full)].argmin(1)]]
        return low.tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo, hi, data, offsets in slices(pa.array(texts, pa.large_string())):
            sh, at = shingles(*self.kernel.word_hashes(data, offsets))
            out += [self.sets(sh[at[i] : at[i + 1]]) for i in range(hi - lo)]
        return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    if not a or not b:
        return float(a == b)
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The texts are shuffled once, into ranges of doc_id. The row that follows a range's last one is sent along with it: one more row for each range.
    """
    spark = documents.sparkSession
    low = -(1 << 63)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(low)))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = bounds(docs, "k", n)
    docs = docs.withColumn("b", bucket(F.col("k"), cuts))
    top = dict(docs.groupBy("b").agg(F.max("k")).collect())  # a row for each range
    if not top:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    filled = sorted(top)
    ahead = [(top[b], filled[(i + 1) % len(filled)]) for i, b in enumerate(filled)]  # descending: a range is followed by the one below
    sent = spark.createDataFrame(ahead, "k long, to int")
    dealt = docs.join(F.broadcast(sent), "k", "left").select(
        "doc_id", "text", "k", F.explode(F.when(F.col("to").isNull(), F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("ahead")))).otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("ahead")), F.struct(F.col("to").alias("b"), F.lit(1).alias("ahead"))))).alias("at")
    ).select("doc_id", "text", "k", "at.b", "at.ahead")
    dealt = spread(dealt, "b", len(cuts) + 1).sortWithinPartitions("b", "ahead", F.desc("k"), "text").select("doc_id", "text", "b", "ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter()
        held = None  # (doc_id, text, bucket, fingerprint) that waits for its next
        for batch in batches:
            ids, texts, buckets, flags = batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["b"].to_pylist(), batch["ahead"].to_pylist()
            prints = maker.texts(texts)
            done = []
            for row in zip(ids, texts, buckets, prints, flags):
                if held is not None and held[2] == row[2]:
                    done.append((held, row))
                    held = None
                if not row[4]:
                    held = row
            if not done:
                continue
            new = [edited(a[1], b[1]) for a, b in done]
            new_prints = maker.texts(new)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([a[0] for a, _ in done], pa.int64()),
                    "n_chars": pa.array([len(a[1]) for a, _ in done], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new]),
                    "fingerprint": pa.array([a[3].hex() for a, _ in done]),
                    "edited_fingerprint": pa.array([p.hex() for p in new_prints]),
                    "near_edited": pa.array([likeness(a[3], p) for (a, _), p in zip(done, new_prints)]),
                    "near_next": pa.array([likeness(a[3], b[3]) for a, b in done]),
                }
            )

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
