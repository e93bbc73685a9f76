"""Vectorised kernels over Arrow string columns: slices, words, word hashes, shingles.

All work runs on flat byte buffers with numpy, in slices of bounded size (one row at least), so that a worker's memory depends on the slice and the longest row only.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9FB21C651E98DF25, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64) | np.uint64(1)


def _seed(k: int) -> np.uint64:
    return np.uint64(k * int(_MULS[15]) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with up to limit bytes, or one longer row."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Kernel:
    """Tables for hashing; one per task."""

    def __init__(self, extra_separators: bool = False, lower: bool = True) -> None:
        byte = np.arange(256)
        self.sep = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
        if extra_separators:  # every ASCII byte that is no letter or digit
            self.sep |= (byte < 128) & ~(((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122)))
        self.value = (byte + 1).astype(np.uint64)
        if lower:
            self.value[65:91] += np.uint64(32)
        self._grow(SLICE_BYTES + 1)

    def _grow(self, n: int) -> None:
        step, back = np.full(n, _BASE, np.uint64), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
        step[0] = back[0] = 1
        self.power, self.inverse = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)

    def points(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A value for every character (code point), 0 for separators, and the rows' offsets among the characters."""
        v = np.where(self.sep[data], np.uint64(0), self.value[data])
        if not len(data) or data.max() < 0x80:
            return v, offsets
        start = (data & 0xC0) != 0x80
        at = np.flatnonzero(start)
        out = v[at]
        wide = np.flatnonzero(data[at] >= 0xC0)
        lead = at[wide]
        code, more = data[lead].astype(np.uint64), np.ones(len(lead), bool)
        for j in range(1, 4):  # the bytes that go on with the character
            here = np.minimum(lead + j, len(data) - 1)
            more &= (lead + j < len(data)) & ~start[here]
            code = np.where(more, (code << np.uint64(8)) | data[here], code)
        out[wide] = code  # two bytes at least, above all single ones
        return out, np.searchsorted(at, offsets)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a polynomial hash, for spans()."""
        if len(data) >= len(self.power):
            self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=out[1:], dtype=np.uint64)
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes (after lower-casing) have equal hashes."""
        return mix((prefix[ends] - prefix[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each row the index of its first word (n+1 entries)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        sep = self.sep[data]
        before, after = np.empty_like(sep), np.empty_like(sep)
        before[1:], after[:-1] = sep[:-1], sep[1:]
        inner = offsets[offsets < len(data)]
        before[inner], after[inner - 1], before[0], after[-1] = True, True, True, True
        starts, ends = np.flatnonzero(before & ~sep), np.flatnonzero(after & ~sep) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def word_hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the first word of each row (n+1 entries)."""
        starts, ends, first = self.words(data, offsets)
        return self.spans(self.prefix(data), starts, ends), first


def ngrams(v: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, place) of every run of n values inside a row."""
    m = len(v) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    packed = v[:m] * _MULS[0]
    for j in range(1, n):
        packed += v[j : j + m] * _MULS[j]
    ok = np.flatnonzero(row[:m] == row[n - 1 :])
    return row[ok], mix(packed[ok] + _seed(n)), ok


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles row by row, and the first of each row; a row with 1 to k-1 words has its whole sequence as one."""
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.zeros(len(first), np.int64)
    np.cumsum(many, out=at[1:])
    out = np.zeros(at[-1], np.uint64)
    if len(hashes) >= k:
        m = len(hashes) - k + 1
        rolled = np.full(m, _seed(k), np.uint64)
        for j in range(k):
            rolled += hashes[j : j + m] * _MULS[j]
        rows = np.repeat(np.arange(len(n)), np.where(n >= k, many, 0))
        pos = np.arange(len(rows)) - np.repeat(np.cumsum(np.where(n >= k, many, 0)) - np.where(n >= k, many, 0), np.where(n >= k, many, 0))
        out[at[rows] + pos] = rolled[first[rows] + pos]
    for size in range(1, k):
        rows = np.flatnonzero(n == size)
        if len(rows):
            acc = np.full(len(rows), _seed(size), np.uint64)
            for j in range(size):
                acc += hashes[first[rows] + j] * _MULS[j]
            out[at[rows]] = acc
    return mix(out), at


class Table:
    """Places of 64-bit keys in a sorted array, by a radix directory: the upper bits name a short run."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(1, min(22, int(len(keys)).bit_length()))
        start = np.zeros((1 << self.bits) + 1, np.int32)
        for i in range(0, len(keys), 1 << 18):  # keys are sorted, so a part of them has few upper bits
            upper = (keys[i : i + (1 << 18)] >> np.uint64(64 - self.bits)).astype(np.int64)
            count = np.bincount(upper - upper[0])
            start[1 + upper[0] : 1 + upper[0] + len(count)] += count.astype(np.int32)
        self.start = np.cumsum(start, dtype=np.int32, out=start)[:-1]

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1."""
        out = np.full(len(values), -1, np.int64)
        if not len(self.keys):
            return out
        at = self.start[(values >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        rest = np.arange(len(values))
        wanted = values
        while len(rest):
            inside = at < len(self.keys)
            got = self.keys[np.where(inside, at, 0)]
            hit = inside & (got == wanted)
            out[rest[hit]] = at[hit]
            more = inside & (got < wanted)
            rest, wanted, at = rest[more], wanted[more], at[more] + 1
        return out
