"""Language identification by language-bitmask n-gram filters (bit-sliced Bloom filters).

One Bloom filter per language, sliced by bit position: slot i of the table is a mask with a bit for each language whose filter has bit i set. The AND of an n-gram's k slots is the mask of all languages that contain it.
N-grams are of characters (code points). For each document the languages' bits are counted over its n-grams, each count is corrected for the filter's false positives, and the language of the highest corrected share wins.

Only text and lang of training rows are used for learning; a prediction sees the text only.
Defined cases: null text or text without a letter is `und` with score 0; ties go to the language with the most training rows; repeated rows get equal results; an empty table gives no rows, no training rows give `und` throughout; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, filter_batches, map_batches, sample_by_hash, tidy
from quarry.llm.kernel import Kernel, ngrams, slices

SLOT_BITS = 22
FEW = 20  # training rows
PROBES = 3
_SPREAD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def grams(data: np.ndarray, offsets: np.ndarray, kernel: Kernel, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-gram of n characters (code points, A-Z lower-cased), white space and ASCII symbols folded to one mark, with one mark at most."""
    v, at = kernel.points(data, offsets)
    row, h, place = ngrams(v, at, n)
    if not len(h):
        return row, h
    marks = np.append(0, np.cumsum(v == 0, dtype=np.int32))
    ok = marks[place + n] - marks[place] <= 1
    return row[ok], h[ok]


def slots(h: np.ndarray) -> list[np.ndarray]:
    """Places of n-gram hashes in a filter, one for each probe."""
    return [((h * np.uint64(m | 1)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in _SPREAD[:PROBES]]


@dataclass
class LanguageModel:
    """languages: in order of their bits; table: (words, slots) masks of 64 languages each; noise: false-positive rate of each language; prior: its share of the training rows."""

    languages: list[str]
    table: np.ndarray
    noise: np.ndarray
    prior: np.ndarray
    n: int

    def predict(self, column: pa.Array, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, score, share of n-grams that the language has, n-grams)."""
        count = len(self.languages)
        best, score, share, number = np.full(len(column), -1), np.zeros(len(column)), np.zeros(len(column)), np.zeros(len(column), np.int64)
        for lo, hi, data, offsets in slices(column):
            rows, h = grams(data, offsets, kernel, self.n)
            if not count:
                continue
            h &= ~np.uint64(1)  # as in training, where hashes travel as signed longs
            total = number[lo:hi] = np.bincount(rows, minlength=hi - lo)
            at = slots(h)
            have = np.zeros((hi - lo, count))
            for word in range(self.table.shape[0]):
                mask = self.table[word][at[0]]
                for s in at[1:]:
                    mask &= self.table[word][s]
                for bit in range(min(64, count - 64 * word)):
                    hit = (mask >> np.uint64(bit)) & np.uint64(1)
                    have[:, 64 * word + bit] = np.bincount(rows, hit, hi - lo)
            corrected = np.clip((have - total[:, None] * self.noise) / (1 - self.noise), 0, None)
            top = (corrected + 1e-6 * self.prior).argmax(1)
            value = corrected[np.arange(hi - lo), top]
            # odds against the next language: each n-gram that only one of the two has counts once, with one added for each
            rest = corrected.copy()
            rest[np.arange(hi - lo), top] = -1
            second = rest.max(1).clip(0) if count > 1 else np.zeros(hi - lo)
            best[lo:hi], share[lo:hi] = top, value / np.maximum(total, 1)
            score[lo:hi] = (value + 1) / (value + second + 2) if count > 1 else value / np.maximum(total, 1)
        letter = regex.compile(r"\p{L}")
        for i, text in enumerate(column.to_pylist()):
            if text is None or not letter.search(text):
                best[i], score[i], share[i] = -1, 0.0, 0.0
        return best, score, share, number


def train(documents: DataFrame, held_out_mod: int = 4, held_out_rest: int = 2, per_language: int = 1500, n: int = 4, least: float = 2e-6) -> LanguageModel:
    """Learns from about per_language training rows of each language (the documented bound). An n-gram enters a language's filter if it is at least the share `least` of the sampled n-grams and occurs in two documents (one is enough in a language with under FEW training rows)."""
    known = documents.select("doc_id", "text", F.col("lang").alias("language")).where("language is not null and text is not null").where(crc_mod("doc_id", held_out_mod) != held_out_rest)
    seen = {r[0]: r[1] for r in known.groupBy("language").count().collect()}  # languages are few
    languages = sorted(seen)
    number = {x: i for i, x in enumerate(languages)}

    def make():
        kernel = Kernel(extra_separators=True)

        def step(batch: pa.RecordBatch) -> dict:
            lang = np.array([number[x] for x in batch["language"].to_pylist()], dtype=np.int64)
            out = []
            for lo, hi, data, offsets in slices(batch["text"]):
                rows, h = grams(data, offsets, kernel, n)
                h >>= np.uint64(1)  # fits a signed long
                order = np.lexsort((rows, h, lang[lo + rows]))
                out.append((lang[lo + rows][order], h[order], rows[order]))
            parts = []
            for g, h, r in out:
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
                start = np.flatnonzero(new)
                first_of_doc = np.ones(len(h), bool)
                first_of_doc[1:] = new[1:] | (r[1:] != r[:-1])
                if len(start):
                    parts.append((g[start], h[start], np.diff(np.append(start, len(h))), np.add.reduceat(first_of_doc.astype(np.int64), start)))
            if not parts:
                return None
            g, h, c, d = (np.concatenate(x) for x in zip(*parts))
            return {"language": pa.array(g.astype(np.int32)), "gram": pa.array(h.astype(np.int64)), "c": pa.array(c), "d": pa.array(d)}

        return step

    counted = map_batches(sample_by_hash(known, "language", "doc_id", per_language).select("text", "language"), make, "language int, gram long, c long, d long")
    counts = counted.groupBy("language", "gram").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    size = {r[0]: r[1] for r in counted.groupBy("language").agg(F.sum("c")).collect()}
    table = np.zeros(((len(languages) + 63) // 64, 1 << SLOT_BITS), np.uint64)
    if not size:
        return LanguageModel([], table, np.zeros(0), np.zeros(0), n)
    need = F.create_map(*[F.lit(x) for k, v in size.items() for x in (k, max(1.0, least * v))])
    few = [number[x] for x in languages if seen[x] < FEW]
    kept = counts.where((F.col("c") >= need[F.col("language")]) & ((F.col("d") >= 2) | F.col("language").isin(few))).select("language", "gram")  # at most 1 / least n-grams a language
    rows = kept.toArrow()
    language, gram = rows["language"].to_numpy(), rows["gram"].to_numpy().view(np.uint64) << np.uint64(1)
    for i in range(len(languages)):
        for at in slots(gram[language == i]):
            table[i // 64, at] |= np.uint64(1 << (i % 64))  # repeated places set the same bit
    del rows, language, gram
    tidy(documents.sparkSession)
    noise = np.array([(((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** PROBES for i in range(len(languages))])
    return LanguageModel(languages, table, noise, np.array([seen[x] for x in languages]) / sum(seen.values()), n)


def predict(documents: DataFrame, model: LanguageModel, held_out_mod: int = 4, held_out_rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        kernel, names = Kernel(extra_separators=True), np.array([*shared.value.languages, "und"], dtype=object)

        def step(batch: pa.RecordBatch) -> dict:
            best, score, _, _ = shared.value.predict(batch["text"], kernel)
            return {"doc_id": batch["doc_id"], "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score)}

        return step

    out = map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (crc_mod("doc_id", held_out_mod) == held_out_rest).alias("held_out"), "lang_pred", "score")


def reject(documents: DataFrame, model: LanguageModel, least_share: float = 0.1, least_grams: int = 40) -> DataFrame:
    """The rows, whole, that are in a learned language. Those without letters go, and those with under least_share of their n-grams in the best language's filter, if they have n-grams enough to tell."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        kernel = Kernel(extra_separators=True)

        def step(batch: pa.RecordBatch) -> np.ndarray:
            best, _, share, n = shared.value.predict(batch["text"], kernel)
            return (best >= 0) & ((share >= least_share) | (n < least_grams))

        return step

    return filter_batches(documents, make)
