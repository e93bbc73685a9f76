"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits, A-Z lower-cased. A mask reads some of the tokens under it and ignores the rest, so a substituted token under a gap does not hide a match.
The masks' hashes of all benchmark positions are joined with those of all document positions; around every hit the two token sequences are laid along each other without gaps, and the pair is a contamination if some window of 13 tokens (the whole item, if it is shorter) has at least 80 % equal tokens.
The masks find every window of 13 with up to two substituted tokens. Items of under 13 tokens have masks of their own, which find each as a whole with as many substituted tokens as the share allows (both checked by tests).

The benchmark is a stated query set: it is taken in blocks of a fixed number of tokens, each block is broadcast, and every document meets every block; nothing is shuffled.
Defined cases: null or empty texts and items match nothing; repeated rows get equal results; an empty benchmark contaminates nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import filter_batches, map_batches
from quarry.llm.kernel import _MULS, Kernel, mix, slices

#: Fixed masks: 1 reads a token, 0 ignores it.
MASKS = ("11010011", "111000111", "1110111")
WINDOW = 13
SHARE = 80  # per cent of a window
BLOOM_BITS = 20


def masked(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of every position under the mask."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, (number + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j, read in enumerate(mask):
        if read == "1":
            out += h[j : j + m] * _MULS[j]
    return mix(out)


def short_masks(n: int) -> list[tuple[str, int]]:
    """Masks for an item of n < 13 tokens, without the gaps at their ends, and the place of the first token read: the item is split in twice as many groups as tokens may differ (three for one token), and every mask leaves out as many groups."""
    differ = n * (100 - SHARE) // 100
    groups = np.arange(n) * max(1, (0, 3, 4)[differ]) // n
    out = []
    for left in combinations(range((0, 3, 4)[differ]), differ) if differ else [()]:
        mask = "".join("0" if g in left else "1" for g in groups)
        out.append((mask.strip("0"), mask.index("1")))
    return out


@dataclass
class Index:
    """Seeds of a block of benchmark items, sorted by hash, and the items' tokens."""

    masks: list[str]
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray
    tokens: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    bloom: np.ndarray

    def matches(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item number, share of equal tokens in the best window) of every contamination, possibly repeated."""
        found = []
        for number, mask in enumerate(self.masks):
            seed = masked(h, mask, number)
            if not len(seed):
                continue
            at = np.flatnonzero(self.bloom[(seed >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)])
            at = at[rows[at] == rows[at + len(mask) - 1]]
            lo, hi = np.searchsorted(self.keys, seed[at], "left"), np.searchsorted(self.keys, seed[at], "right")
            n = hi - lo
            if n.sum():
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                entry = np.repeat(lo, n) + within
                found.append(np.stack([np.repeat(at, n), entry]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at, entry = np.concatenate(found, axis=1)
        item, place = self.item[entry], self.place[entry]
        start, item, at = np.unique(np.stack([at - place, item, at]), axis=1)  # document position of the item's first token, on this diagonal
        length = self.first[item + 1] - self.first[item]
        window = np.minimum(length, WINDOW)
        best = np.zeros(len(at))
        span = np.arange(-WINDOW, 2 * WINDOW)
        for i in range(0, len(at), 1 << 14):  # bounded memory
            s, t, a = start[i : i + (1 << 14), None], item[i : i + (1 << 14)], at[i : i + (1 << 14)]
            pos = a[:, None] + span
            inner = pos - s
            ok = (pos >= 0) & (pos < len(h)) & (inner >= 0) & (inner < length[i : i + (1 << 14), None])
            p, q = np.where(ok, pos, 0), np.where(ok, self.first[t][:, None] + inner, 0)
            same = ok & (h[p] == self.tokens[q]) & (rows[p] == rows[a][:, None])
            total = np.zeros((len(a), len(span) + 1), np.int64)
            np.cumsum(same, axis=1, out=total[:, 1:])
            w = window[i : i + (1 << 14)]
            for size in np.unique(w):
                of = w == size
                best[i : i + (1 << 14)][of] = (total[of, size:] - total[of, :-size]).max(1) / size
        good = best * 100 >= SHARE - 1e-9
        return rows[at[good]], item[good], best[good]


def build(items: list[tuple[int, str]]) -> Index:
    """Index of (item id, text) pairs."""
    kernel = Kernel(extra_separators=True)
    texts = pa.array([t or "" for _, t in items], pa.string())
    parts, first = [], [0]
    for _, _, data, offsets in slices(texts):
        h, f = kernel.word_hashes(data, offsets)
        parts.append(h)
        first += list(f[1:] + first[-1])
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    first = np.array(first, np.int64)
    length = np.diff(first)
    short = [(int(n), mask, lead) for n in np.unique(length) if 0 < n < WINDOW for mask, lead in short_masks(int(n))]
    masks = list(dict.fromkeys([*MASKS, *(mask for _, mask, _ in short)]))
    owner = np.repeat(np.arange(len(items)), length)
    keys, item, place = [], [], []
    for number, mask in enumerate(masks):
        seed = masked(tokens, mask, number)
        at = np.arange(len(seed))
        ok = owner[at] == owner[at + len(mask) - 1] if len(seed) else np.zeros(0, bool)
        if number >= len(MASKS):  # short items only
            wanted = np.zeros(len(seed), bool)
            for n, other, lead in short:
                if other == mask:
                    wanted |= (length[owner[at]] == n) & (at - first[owner[at]] == lead)
            ok &= wanted
        keys.append(seed[ok]), item.append(owner[at][ok]), place.append((at - first[owner[at]])[ok])
    keys, item, place = np.concatenate(keys), np.concatenate(item), np.concatenate(place)
    order = np.argsort(keys, kind="stable")
    bloom = np.zeros(1 << BLOOM_BITS, bool)
    bloom[(keys >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)] = True
    return Index(masks, keys[order], item[order], place[order], tokens, first, np.array([i for i, _ in items], dtype=np.int64), bloom)


def blocks(benchmark: DataFrame, chars: int = 8_000_000) -> Iterator[tuple[Index, bool]]:
    """Indexes of the benchmark in blocks of about so many characters, one after the other, and whether it is the last; how many blocks there are comes from the sum of the lengths before any is read."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
    numbers = sorted(r[0] for r in numbered.select("block").distinct().collect())  # a number for each block
    for number in numbers:
        rows = numbered.where(F.col("block") == number).select("item_id", "text").collect()  # one block
        yield build(sorted((r[0], r[1]) for r in rows)), number == numbers[-1]


def _per_document(index: Index, column: pa.Array, kernel: Kernel) -> tuple[list, np.ndarray]:
    """For every row the sorted ids of the items that it holds, and the best window's share."""
    items: list = [[] for _ in range(len(column))]
    best = np.zeros(len(column))
    for lo, hi, data, offsets in slices(column):
        h, first = kernel.word_hashes(data, offsets)
        rows = np.repeat(np.arange(hi - lo), np.diff(first))
        r, i, share = index.matches(h, rows)
        np.maximum.at(best, lo + r, share)
        for a, b in np.unique(np.stack([r, i]), axis=1).T if len(r) else ():
            items[lo + a].append(int(index.ids[b]))
    return [sorted(set(x)) for x in items], best


def scan(documents: DataFrame, benchmark: DataFrame, chars: int = 8_000_000) -> DataFrame:
    """doc_id, contaminated, items, best_share for every row. Each block of the benchmark is a pass over the rows; only the last one leaves the texts behind."""
    none = F.array().cast("array<long>")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", none.alias("items"), F.lit(0.0).alias("best_share"))
    for index, last in blocks(benchmark, chars):
        shared = documents.sparkSession.sparkContext.broadcast(index)
        del index

        def make(shared=shared, last=last):
            kernel = Kernel(extra_separators=True)

            def step(batch: pa.RecordBatch) -> dict:
                items, best = _per_document(shared.value, batch["text"], kernel)
                items = [sorted({*old, *new}) for old, new in zip(batch["items"].to_pylist(), items)]
                out = {"doc_id": batch["doc_id"], "items": pa.array(items, pa.list_(pa.int64())), "best_share": pa.array(np.maximum(best, batch["best_share"].to_numpy()))}
                return out if last else {"doc_id": batch["doc_id"], "text": batch["text"]} | out

            return step

        rows = map_batches(rows, make, "doc_id long, items array<long>, best_share double" if last else "doc_id long, text string, items array<long>, best_share double")
    return rows.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "best_share")


def clean(documents: DataFrame, benchmark: DataFrame, chars: int = 8_000_000) -> DataFrame:
    """The rows, whole, that hold no benchmark passage; each block is a pass over the rows that are left."""
    for index, _ in blocks(benchmark, chars):
        shared = documents.sparkSession.sparkContext.broadcast(index)
        del index

        def make(shared=shared):
            kernel = Kernel(extra_separators=True)
            return lambda batch: np.array([not x for x in _per_document(shared.value, batch["text"], kernel)[0]], dtype=bool)

        documents = filter_batches(documents, make)
    return documents
