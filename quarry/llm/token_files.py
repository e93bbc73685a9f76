"""Token-id files by an adaptive context-mixing range coder.

A shard holds the ids of whole documents in ascending doc_id order, cut into blocks of 2,048 ids. Every block starts from the same fresh model, has its own CRC-32 and can be decoded by itself; the shard's order-0 table (each id's frequency, to a total of a power of two) stands in the header.
Model of a block, in integers only, so that any machine decodes alike:
- order 2 and order 1: hashed contexts of the last two ids and of the last id remember an id and a confidence; the order-2 id is predicted where there is one, else the order-1 id;
- the probability that the prediction holds is mixed in the logistic domain from three adaptive inputs: the hit rates seen at the order-2 and order-1 confidences, and the predicted id's order-0 frequency; the mixer's weights learn online;
- a missed prediction is followed by the id under the order-0 table.
Both decisions drive one carry-less 64-bit range coder with 16-bit words. All blocks of a shard are coded in lockstep, a numpy lane for each.

Layout (little-endian): magic QTK1; u32 documents, blocks, block size, table bits, table entries; doc ids (i64; a bit of the lengths' sign marks null ids), u64 lengths; table ids (u32) and frequencies (u32); for each block u32 ids, u32 words, u32 CRC-32 of its ids; the blocks' words; u32 CRC-32 of all before.

Defined cases: null and empty texts have the end id only; repeated rows and doc ids are written each, ordered by text; rows without a doc_id come first; an empty table gives no shards and no rows; other columns are not read; a text of any length stays in one shard.
"""

from __future__ import annotations

import os
import re
import sys
import types
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.kernel import Kernel, Table, slices
from quarry.session import scratch, stored

BLOCK = 2048
SHARD = 4096 * BLOCK  # ids, about
SLOTS = 9  # log2 of a block's contexts of each order
LIMIT = 2047
# numpy takes constants faster as arrays without dimensions
_TOP, _BOTTOM, _UNIT, _WORD, _HIGH = (np.array(x, np.uint64) for x in (1 << 48, 1 << 40, 1, 16, 48))
_CODE, _ONE, _FRESH, _SIX, _SCALE, _SLOW = (np.array(x, np.int32) for x in (31, 5, 2, 6, 18, 16))
_FULL, _RATE = np.array(4095, np.int16), np.array(4, np.int16)
_KNOWN, _SHIFT, _NEXT = np.array(3), np.array(32 - SLOTS), np.array(1)
_ID, _PAIR, _OLDER = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0x5BD1E995)  # of hashes
_STEP = 3070  # of a weight in one update, at most
_DOT = 12288  # of the mixed inputs, at most
_RUN, _WORDS = 16, 8  # steps that are prepared together; words that a step can settle, at most


#: A word with at most one space before it: letters of ASCII, of U+00C0 to U+023F and Cyrillic ones, which the byte-level pre-tokenizer never cuts.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC8\xD0][\x80-\xBF])+")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: logistic of x / 256 in 1/4096, for x from -2047 to 2047; stretch: its inverse. Built in integers from a rounded table."""
    x = np.arange(-LIMIT, LIMIT + 1)
    squash = np.clip(np.round(4096 / (1 + np.exp(-x / 256))), 1, 4095).astype(np.int32)
    stretch = (np.searchsorted(squash, np.arange(4096)) - LIMIT).clip(-LIMIT, LIMIT).astype(np.int32)
    return squash, stretch


class _Model:
    """The predictors of all lanes. What both orders share is done for both at once: arrays of 2 n have order 2 in their first half, order 1 in the other."""

    def __init__(self, lanes: int, prior: np.ndarray) -> None:
        squash, self.stretch = _tables()
        dot = np.append(np.arange(_DOT), np.arange(-_DOT, 0))  # a negative place counts from the end
        self.squash = squash[dot.clip(-LIMIT, LIMIT) + LIMIT] << 4
        self.prior = prior  # by id: stretched order-0 probability
        self.table = np.zeros(2 * lanes << SLOTS, np.int32)  # id << 5 | confidence << 1
        self.rate = np.full(2 * lanes << 5, 2048, np.int16)  # by confidence << 1; in order 1 also by whether both orders agree
        confidence = np.arange(32) >> 1
        self.change = np.where(np.arange(32) & 1, confidence < 15, -((confidence + 1) >> 1)).astype(np.int32) << 1  # by confidence << 1 | hit
        self.weight = np.repeat(np.array([[26000], [20000], [8000]], np.int32), lanes, axis=1)  # of 65536
        self.s = np.zeros((3, lanes), np.int32)
        self.both, self.free = self.s[:2].reshape(-1), 0
        self.last, self.older = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)  # hashes of the last two ids
        lane = np.arange(2 * lanes)
        self.base, self.rate_base = lane << SLOTS, lane << 5
        self.n = lanes

    def cut(self, n: int) -> None:
        """Keeps the first n lanes."""
        if n != self.n:
            self.weight, self.s = np.ascontiguousarray(self.weight[:, :n]), np.ascontiguousarray(self.s[:, :n])
            self.both = self.s[:2].reshape(-1)
            self.base, self.rate_base = (x.reshape(2, -1)[:, :n].reshape(-1) for x in (self.base, self.rate_base))
            self.last, self.older, self.n = self.last[:n], self.older[:n], n

    def places(self) -> np.ndarray:
        """Places in the table of the next id's contexts."""
        h = np.empty((2, self.n), np.int64)
        h[0], h[1] = (self.last ^ self.older) * _PAIR, self.last
        h >>= _SHIFT
        at = h.reshape(-1)
        at += self.base
        return at

    def places_of(self, run: np.ndarray) -> np.ndarray:
        """The places for each of a run of steps whose ids are known."""
        steps = len(run)
        last, older = np.empty((steps + 1, self.n), np.uint32), np.empty((steps + 1, self.n), np.uint32)
        last[0], older[0] = self.last, self.older
        np.multiply(run.view(np.uint32), _ID, out=last[1:])
        np.bitwise_xor(last[:-1], _OLDER, out=older[1:])
        h = np.empty((steps, 2, self.n), np.int64)
        h[:, 0], h[:, 1] = (last[:-1] ^ older[:-1]) * _PAIR, last[:-1]
        h >>= _SHIFT
        self.last, self.older = last[-1], older[-1]
        at = h.reshape(steps, -1)
        at += self.base
        return at

    def predict(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predicted id, probability of 65536) for the lanes, whose contexts are at these places."""
        n = self.n
        self.at, self.e = at, self.table.take(at)
        self.had, self.c = self.e >> _ONE, (self.e & _CODE).astype(np.int64)
        one = self.had[n:]
        guess = np.where(self.c[:n] > 0, self.had[:n], one)
        self.inner = self.rate_base + self.c
        self.inner[n:] += one == guess
        self.q = self.rate.take(self.inner)
        self.stretch.take(self.q, out=self.both, mode="clip")
        self.prior.take(guess, out=self.s[2], mode="clip")
        x = self.weight * self.s
        dot = x[0]
        dot += x[1]
        dot += x[2]
        dot >>= _SLOW
        self.p = self.squash.take(dot)
        return guess, self.p

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        wrong = (hit.astype(np.int32) << _SLOW) - self.p
        wrong *= _SIX
        step = self.s * wrong
        step >>= _SCALE
        self.weight += step
        self.free -= 1
        if self.free < 0:  # else no weight can have left its limits
            np.minimum(self.weight, 131072, out=self.weight)
            np.maximum(self.weight, -65536, out=self.weight)
            self.free = min(131072 - int(self.weight.max(initial=0)), 65536 + int(self.weight.min(initial=0))) // _STEP
        goal = hit.astype(np.int16)
        goal *= _FULL
        q = self.q.reshape(2, -1)
        move = goal - q
        move >>= _RATE
        q += move
        self.rate[self.inner] = self.q
        k = self.c.reshape(2, -1)
        k += self.had.reshape(2, -1) == ids
        self.e += self.change.take(self.c)
        self.table[self.at] = np.where(k < _KNOWN, (ids << _ONE) | _FRESH, self.e.reshape(2, -1)).reshape(-1)

    def follow(self, ids: np.ndarray) -> None:
        """The ids just coded are the next one's context."""
        self.older = self.last ^ _OLDER
        self.last = ids.view(np.uint32) * _ID


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct ids, frequencies that add up to 2^bits, bits."""
    distinct, count = np.unique(ids, return_counts=True)
    bits = max(16, int(len(distinct)).bit_length() + 1)
    freq = np.maximum(1, (count * ((1 << bits) - len(distinct)) // max(1, count.sum()))).astype(np.int64)
    if len(freq):
        freq[np.argmax(freq)] += (1 << bits) - freq.sum()
    return distinct.astype(np.int64), freq, bits


def _prior(distinct: np.ndarray, freq: np.ndarray, bits: int) -> np.ndarray:
    out = np.full(int(distinct.max(initial=0)) + 1, -LIMIT, np.int32)
    out[distinct] = _tables()[1][np.clip((freq << 12) >> bits, 1, 4095)]
    return out


class _Lanes:
    """Range-coder state: low and range of every lane."""

    def __init__(self, lanes: int) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def cut(self, n: int) -> None:
        self.low, self.range = self.low[:n], self.range[:n]

    def shift(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields the lanes whose top word is settled, and their low, until there are none; the caller moves the word. A word is settled or short of range only where the range is below a word's."""
        at = (self.range < _TOP).nonzero()[0]
        while len(at):
            low, rng = self.low[at], self.range[at]
            go = (low ^ (low + rng)) < _TOP
            short = rng < _BOTTOM
            short &= ~go
            if short.any():
                rng[short] = (~low[short] + _UNIT) & (_BOTTOM - _UNIT)
                go |= short
            here = go.nonzero()[0]
            if len(here) < len(at):
                at, low, rng = at[here], low[here], rng[here]
                if not len(at):
                    return
            yield at, low
            rng <<= _WORD
            self.low[at], self.range[at] = low << _WORD, rng
            at = at[rng < _TOP]


def encode_ids(ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, tuple]:
    """(words of all blocks, words in each block, CRC-32 of each block's ids, order-0 table)."""
    lanes = -(-len(ids) // BLOCK)
    distinct, freq, bits = table = _order0(ids)
    cum = np.zeros(len(distinct) + 1, np.int64)
    np.cumsum(freq, out=cum[1:])
    model, state = _Model(lanes, _prior(*table)), _Lanes(lanes)
    rest = state.low
    padded = np.zeros(lanes * BLOCK, np.int32)
    padded[: len(ids)] = ids
    steps, bits = padded.reshape(lanes, BLOCK), np.array(bits, np.uint64)
    place = np.zeros(int(distinct.max(initial=0)) + 1, np.int64)
    place[distinct] = np.arange(len(distinct))
    cum, freq = cum.astype(np.uint64), freq.astype(np.uint64)
    last = len(ids) - (lanes - 1) * BLOCK if lanes else 0
    width = BLOCK + 64 + _RUN * _WORDS
    words, used = np.zeros((lanes, width), np.uint16), np.zeros(lanes, np.int64)
    ends = sorted({*range(0, BLOCK, _RUN), last, BLOCK}) if lanes > 1 else [*range(0, last, _RUN), last]
    for begin, end in zip(ends, ends[1:]):
        n = lanes if begin < last else lanes - 1
        model.cut(n), state.cut(n)
        if used.max() + (_RUN + 1) * _WORDS > words.shape[1]:
            words = np.concatenate([words, np.zeros_like(words)], axis=1)
        flat, free = words.reshape(-1), used[:n] + np.arange(n) * words.shape[1]
        run = np.ascontiguousarray(steps[:n, begin:end].T)
        at = place.take(run)
        starts, widths = cum.take(at), freq.take(at)
        for x, places, start, size in zip(run, model.places_of(run), starts, widths):
            guess, p = model.predict(places)
            hit = guess == x
            r = state.range >> _WORD
            edge = r * p.astype(np.uint64)
            miss = (~hit).nonzero()[0]
            if len(miss):
                over = edge[miss]
                r = ((r[miss] << _WORD) - over) >> bits
                over += r * start[miss]
                over += state.low[miss]
                r *= size[miss]
                state.low[miss], edge[miss] = over, r
            state.range = edge
            for lane, low in state.shift():
                to = free[lane]
                flat[to] = low >> _HIGH
                to += _NEXT
                free[lane] = to
            model.update(x, hit)
        used[:n] = free - np.arange(n) * words.shape[1]
    for k in (48, 32, 16, 0):  # the rest of low
        words[np.arange(lanes), used] = (rest >> np.uint64(k)).astype(np.uint16)
        used += 1
    raw = words[np.arange(words.shape[1])[None, :] < used[:, None]].astype("<u2").tobytes()
    crc = np.array([zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)], dtype=np.int64)
    return raw, used, crc, table


def decode_ids(raw: bytes, used: np.ndarray, sizes: np.ndarray, crc: np.ndarray, table: tuple) -> np.ndarray:
    """The ids of blocks in lockstep; raises ValueError where a block's checksum fails. sizes: descending from the full size."""
    lanes = len(used)
    distinct, freq, bits = table
    cum = np.zeros(len(distinct) + 1, np.int64)
    np.cumsum(freq, out=cum[1:])
    slot = np.repeat(np.arange(len(distinct), dtype=np.int32), freq)
    distinct, cum, freq = distinct.astype(np.int32), cum.astype(np.uint64), freq.astype(np.uint64)
    model, state = _Model(lanes, _prior(*table)), _Lanes(lanes)
    bits = np.array(bits, np.uint64)
    flat = np.append(np.frombuffer(raw, "<u2"), np.zeros(8, np.uint16))
    at = np.append(0, np.cumsum(used))[:-1]
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << _WORD) | flat[at]
        at = at + 1
    longest = int(sizes.max(initial=0))
    out = np.zeros((longest, lanes), np.int32)
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right").tolist() if lanes else []
    for t, n in enumerate(active):
        model.cut(n), state.cut(n)
        code, at = code[:n], at[:n]
        x, p = model.predict(model.places())
        r = state.range >> _WORD
        edge = r * p.astype(np.uint64)
        ahead = code - state.low
        hit = ahead < edge
        miss = (~hit).nonzero()[0]
        if len(miss):
            over = edge[miss]
            r = ((r[miss] << _WORD) - over) >> bits
            v = (ahead[miss] - over) // r
            k = slot.take(v.view(np.int64), mode="clip").astype(np.int64)  # a damaged block may have any v
            x[miss] = distinct[k]
            over += r * cum[k]
            over += state.low[miss]
            r *= freq[k]
            state.low[miss], edge[miss] = over, r
        state.range = edge
        for lane, _ in state.shift():
            to = at[lane]
            code[lane] = (code[lane] << _WORD) | flat.take(to, mode="clip")
            to += _NEXT
            at[lane] = to
        out[t, :n] = x
        model.update(x, hit)
        model.follow(x)
    ids, begin = np.empty(int(sizes.sum()), np.int32), 0
    for i, n in enumerate(sizes.tolist()):
        ids[begin : begin + n] = out[:n, i]
        if zlib.crc32(ids[begin : begin + n].astype("<u4").tobytes()) != crc[i]:
            raise ValueError(f"checksum of block {i} fails")
        begin += n
    return ids


def pack_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard of whole documents."""
    raw, used, crc, (distinct, freq, bits) = encode_ids(ids)
    sizes = np.full(len(used), BLOCK)
    if len(used):
        sizes[-1] = len(ids) - (len(used) - 1) * BLOCK
    null = np.array([x is None for x in doc_ids], dtype=np.uint64) << np.uint64(63)
    body = b"".join(
        [
            b"QTK1",
            np.array([len(doc_ids), len(used), BLOCK, bits, len(distinct)], "<u4").tobytes(),
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
            (lengths.astype(np.uint64) | null).astype("<u8").tobytes(),
            distinct.astype("<u4").tobytes(),
            freq.astype("<u4").tobytes(),
            np.stack([sizes, used, crc], axis=1).astype("<u4").tobytes(),
            raw,
        ]
    )
    return body + np.array([zlib.crc32(body)], "<u4").tobytes()


class Shard:
    """The header of a shard: doc_ids, lengths, the order-0 table and the index of its blocks; ids() and block() decode."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"QTK1" or len(data) < 28:
            raise ValueError("not a shard")
        self.data = data
        docs, lanes, self.size, bits, entries = (int(x) for x in np.frombuffer(data, "<u4", 5, 4))
        at = 24
        doc_ids = np.frombuffer(data, "<i8", docs, at)
        marked = np.frombuffer(data, "<u8", docs, at + 8 * docs)
        at += 16 * docs
        distinct = np.frombuffer(data, "<u4", entries, at).astype(np.int64)
        freq = np.frombuffer(data, "<u4", entries, at + 4 * entries).astype(np.int64)
        at += 8 * entries
        self.table = (distinct, freq, bits)
        self.index = np.frombuffer(data, "<u4", 3 * lanes, at).astype(np.int64).reshape(lanes, 3)  # ids, words, checksum
        self.at = at + 12 * lanes
        null = (marked >> np.uint64(63)).astype(bool)
        self.doc_ids = [None if x else int(i) for x, i in zip(null, doc_ids)]
        self.lengths = (marked & np.uint64((1 << 63) - 1)).astype(np.int64)

    def check(self) -> None:
        """ValueError if the file is damaged."""
        if zlib.crc32(self.data[:-4]) != int(np.frombuffer(self.data[-4:], "<u4")[0]):
            raise ValueError("not a whole shard")

    def block(self, number: int) -> np.ndarray:
        """The ids of one block: only its own words are read, and its own checksum is tested."""
        begin = self.at + 2 * int(self.index[:number, 1].sum())
        own = self.index[number : number + 1]
        return decode_ids(self.data[begin : begin + 2 * int(own[0, 1])], own[:, 1], own[:, 0], own[:, 2], self.table)

    def ids(self) -> np.ndarray:
        return decode_ids(self.data[self.at : -4], self.index[:, 1], self.index[:, 0], self.index[:, 2], self.table)


def unpack_shard(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, lengths, ids) of a shard; ValueError if it is damaged."""
    shard = Shard(data)
    shard.check()
    return shard.doc_ids, shard.lengths, shard.ids()


class Encoder:
    """Ids of texts by a tokenizers file (byte-level BPE). Texts are cut where the pre-tokenizer always begins a new word: before a single space or line end between two visible characters, after such a line end, and between ASCII letters, digits and symbols (but not after an apostrophe); never inside an added token of the file, which the library finds in plain text before it looks for words. Each distinct part is encoded by the library, and kept while there is room; a part that is a single word goes to the library's model at once, as its normalizer, search for added tokens and pre-tokenizer would leave it whole."""

    def __init__(self, path: str, most: int = 1 << 20) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.kernel, self.most = Tokenizer.from_file(path), Kernel(lower=False), most
        b = np.arange(256)
        kind = np.zeros(256, np.uint8)  # 0: other
        kind[(b > 32) & (b < 127)] = 3  # symbols
        kind[(b >= 65) & (b <= 90) | (b >= 97) & (b <= 122)], kind[(b >= 48) & (b <= 57)], kind[39] = 1, 2, 4
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values() if len(t.content.encode()) > 1]
        self.kind, self.visible = kind, kind > 0
        cut = self.library.pre_tokenizer
        plain = self.library.normalizer is None and isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space
        self.words = plain and not any(re.search(r"^[\w\s]*$", t.content) for t in self.library.get_added_tokens_decoder().values())  # whether words may go to the model at once
        printed = (b > 32) & (b < 127) | (b > 160) & (b != 173)
        self.shown = np.where(printed, b, 255 + np.cumsum(~printed)).astype("<u4")  # the character by which a byte-level model knows a byte
        self.after = self.visible | ((b >= 0xC3) & (b <= 0xDF))  # visible, or the lead of a two-byte letter
        self.tail, self.two = (b >= 0x80) & (b < 0xC0), (b >= 0xC3) & (b <= 0xDF)
        self.differs = np.zeros((5, 5), bool)
        for x in range(1, 4):
            for y in range(1, 5):
                self.differs[x, y] = x != y and not (x == 3 and y == 4)
        self.clear()

    def clear(self) -> None:
        """Forgets all parts. They are kept in two sorted tables, an old one and a recent one, which is merged into the old when it has grown to a quarter of it."""
        self.tables = [Table(np.zeros(0, np.uint64)), Table(np.zeros(0, np.uint64))]
        self.first, self.flat = [np.zeros(1, np.int64), np.zeros(1, np.int64)], [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def _merge(self, to: int, keys: np.ndarray, begin: np.ndarray, flat: np.ndarray) -> None:
        keys = np.concatenate([self.tables[to].keys, keys])
        size = np.concatenate([np.diff(self.first[to]), np.diff(begin)])
        flat = np.concatenate([self.flat[to], flat])
        at = np.append(0, np.cumsum(size))[:-1]
        order = np.argsort(keys, kind="stable")
        size = size[order]
        self.first[to] = np.append(0, np.cumsum(size))
        self.flat[to] = flat[np.repeat(at[order] - self.first[to][:-1], size) + np.arange(self.first[to][-1])]
        self.tables[to] = Table(keys[order])

    def keep(self, keys: np.ndarray, begin: np.ndarray, flat: np.ndarray) -> None:
        """Adds new parts while there is room."""
        old, recent = (len(t.keys) for t in self.tables)
        if old + recent + len(keys) > self.most:
            return
        self._merge(1, keys, begin, flat)
        if 4 * len(self.tables[1].keys) > old:
            self._merge(0, self.tables[1].keys, self.first[1], self.flat[1])
            self.tables[1], self.first[1], self.flat[1] = Table(np.zeros(0, np.uint64)), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of parts, with the end of the last."""
        new = np.zeros(len(data), bool)
        if len(data) > 2:
            kind = self.kind[data]
            new[1:] = self.differs[kind[:-1], kind[1:]]
            before = kind[:-2] > 0
            before[1:] |= self.tail[data[1:-2]] & self.two[data[:-3]]
            line = data[1:-1] == 10
            gap = ((data[1:-1] == 32) | line) & before & self.after[data[2:]]
            new[1:-1] |= gap
            new[2:] |= gap & line
        raw = data.tobytes() if self.added else b""
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                new[at + 1 : at + len(token)] = False
                at = raw.find(token, at + 1)
        new[offsets[offsets < len(data)]] = True
        return np.append(np.flatnonzero(new), len(data))

    def _encode(self, data: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of the parts at these places."""
        raw = data.tobytes()
        parts = [raw[i:j] for i, j in zip(starts[at].tolist(), starts[at + 1].tolist())]
        whole = WORD.fullmatch
        words = [i for i, part in enumerate(parts) if whole(part)] if self.words else []
        got: list = [None] * len(parts)
        if words:
            line = np.frombuffer(b"\n".join([parts[i] for i in words]), np.uint8)  # no word holds a line end
            tokens = self.library.model.tokenize
            for i, word in zip(words, self.shown[line].tobytes().decode("utf-32-le").split(chr(self.shown[10]))):
                got[i] = [t.id for t in tokens(word)]
        rest = [i for i, x in enumerate(got) if x is None]
        for i, e in zip(rest, self.library.encode_batch_fast([parts[i].decode() for i in rest], add_special_tokens=False)):
            got[i] = e.ids
        n = np.fromiter(map(len, got), np.int64, len(got))
        return n, np.fromiter(chain.from_iterable(got), np.int32, int(n.sum()))

    def ids(self, column: pa.Array, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, lengths, ids) by slices; end follows every row."""
        for lo, hi, data, offsets in slices(column, 1 << 21):
            rows = hi - lo
            starts = self.cuts(data, offsets)
            first = np.searchsorted(starts[:-1], offsets)
            h = self.kernel.spans(self.kernel.prefix(data), starts[:-1], starts[1:])
            # places in the old table, then the recent one, then the slice's own new parts, laid end to end
            runs = self.tables[0].find(h)
            cold = np.flatnonzero(runs < 0)
            old = len(self.first[0]) - 1
            there = self.tables[1].find(h[cold])
            runs[cold] = np.where(there >= 0, old + there, -1)
            begin = np.concatenate([self.first[0], self.first[0][-1] + self.first[1][1:]])
            flat = np.concatenate([self.flat[0], self.flat[1]])
            cold = cold[there < 0]
            if len(cold):
                distinct, at, of = np.unique(h[cold], return_index=True, return_inverse=True)
                n, got = self._encode(data, starts, cold[at])
                runs[cold] = len(begin) - 1 + of
                begin, flat = np.concatenate([begin, begin[-1] + np.cumsum(n)]), np.concatenate([flat, got])
                self.keep(distinct, np.append(0, np.cumsum(n)), got)
            n = begin[runs + 1] - begin[runs]
            run_at = np.append(0, np.cumsum(n))
            ids = flat[np.repeat(begin[runs] - run_at[:-1], n) + np.arange(run_at[-1])]
            length = run_at[first[1:]] - run_at[first[:-1]] + 1
            out = np.empty(len(ids) + rows, np.int32)
            ends = np.cumsum(length) - 1
            body = np.ones(len(out), bool)
            body[ends] = False
            out[body], out[ends] = ids, end
            yield lo, hi, length, out


def worker_encoder(path: str) -> Encoder:
    """One encoder for each worker process, so that tasks that follow each other share what it has encoded."""
    kept = sys.modules.setdefault("_quarry_worker", types.ModuleType("_quarry_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def save(folder: str, name: str, data: bytes) -> None:
    """Writes a file of a folder that the cluster shares, whole or not at all: a task that is run again replaces it by the same bytes."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    temporary = f"{root}/_{uuid.uuid4().hex}"
    with where.open_output_stream(temporary) as f:
        f.write(data)
    where.move(temporary, f"{root}/{name}")


def write(documents: DataFrame, path: str, end: int = 2, folder: str | None = None) -> str:
    """Writes the shards as files <part>-<number>.qtk, whose names ascend with doc_id, and returns their folder: a new one under the shared scratch folder unless one is named. path: the tokenizer's file."""
    from pyarrow import fs

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    folder = folder or scratch(spark)
    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, number = worker_encoder(path), TaskContext.get().partitionId(), 0
        ids, lengths, tokens, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            flat, size = np.concatenate(tokens), np.concatenate(lengths)
            tokens.clear()
            save(folder, f"{part:06d}-{number:06d}.qtk", pack_shard(ids, size, flat))
            return pa.RecordBatch.from_pydict({"n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([len(flat)], pa.int64())})

        for batch in batches:
            names = batch["doc_id"].to_pylist()
            for lo, hi, length, flat in encoder.ids(batch["text"], end):
                ids += names[lo:hi]
                lengths.append(length), tokens.append(flat)
                held += len(flat)
                if held >= SHARD:
                    yield flush()
                    ids, lengths, tokens, held, number = [], [], [], 0, number + 1
        if ids:
            yield flush()

    ordered.mapInArrow(run, "n_docs long, n_tokens long").agg(F.sum("n_docs"), F.sum("n_tokens")).collect()  # one row
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a folder: a task for each file. A file's first place comes from the lengths in the headers of those before it, which are read first."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.qtk").load(folder).select("path")  # names only, no contents

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            n = []
            for path in batch["path"].to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as f:
                    docs = int(np.frombuffer(f.read(24), "<u4", 1, 4)[0])
                    f.seek(24 + 8 * docs)
                    n.append(int((np.frombuffer(f.read(8 * docs), "<u8") & np.uint64((1 << 63) - 1)).sum()))
            yield pa.RecordBatch.from_pydict({"path": batch["path"], "n": pa.array(n, pa.int64())})

    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(paths.mapInArrow(sizes, "path string, n long").select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as f:
                    doc_ids, lengths, ids = unpack_shard(f.read())
                at = np.append(0, np.cumsum(lengths))
                crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(start + at[:-1]), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())})

    return starts.repartitionByRange(max(1, starts.count()), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
