"""SentencePiece encoding and decoding over a relational lattice.

1. Texts are cut into segments wherever no piece of the vocabulary holds the two neighbouring bytes; no piece spans such a cut, so segments are encoded independently.
2. The distinct segments' substrings, as long as the longest piece at most, are exploded and equi-joined with the piece table; the edges found are grouped by segment.
3. A higher-order aggregate folds each segment's edges. For unigram models it is Viterbi: the best path to each position. For byte-pair models, whose scores are merge ranks and no log probabilities, a path of greatest score isn't the model's encoding; there the fold takes edges in order of rank and merges two symbols where an edge covers exactly these. That replays the merges exactly if every piece's own derivation uses pieces of better rank only, which is checked when the model is read.
4. Documents look their segments up: the most frequent ones (a table of HOT bytes at most, by a threshold over a histogram) in a broadcast table, all others through a join.

Normalisation is the model's: identity only, with its dummy prefix; other normalisers are refused. Characters without a piece become bytes; in a model without byte pieces a run of them is one unknown id.
Defined cases: null and empty texts have no ids; repeated rows are encoded each; an empty table gives no rows; other columns are not read; texts and segments may be of any length.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_batches
from quarry.llm.kernel import Kernel, Table, buffers, slices
from quarry.session import stored

HOT = 64 << 20  # bytes of the segment table that is broadcast
TASK = 1 << 15  # segments whose lattice one task folds, about
LONG = 62  # characters that a segment's boundaries may have in one long
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # types of pieces
UNIGRAM, BPE = 1, 2
UNIT = 1 << 20  # costs of unigram models are whole numbers of 1 / UNIT, so that equal sums are equal in any order
NONE = (1 << 17) - 1  # id of a character without a piece
HUGE = 1 << 12  # characters of a segment beyond which no lattice is laid out: it would be one huge row


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


@dataclass
class Model:
    """pieces: (text with plain spaces, score, type) by id."""

    pieces: list[tuple[str, float, int]]
    kind: int
    prefix: bool

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER)}
        self.longest = max([1, *(len(p) for p in self.ids)])
        at = [i for i, x in enumerate(self.pieces) if x[2] == BYTE]
        self.byte0 = at[0] if len(at) == 256 and at[-1] == at[0] + 255 else None
        self.unknown = next((i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN), 0)
        together = np.zeros((256, 256), bool)
        for p in self.ids:
            b = np.frombuffer(p.encode(), np.uint8)
            together[b[:-1], b[1:]] = True
        together[:, 0x80:0xC0] = True  # never inside a character
        self.together = together

    def worst(self) -> int:
        """An unknown character's cost in unigram models."""
        return round((max(-x[1] for x in self.pieces if x[2] == NORMAL) + 10.0) * UNIT)

    def merged(self, text: str) -> tuple[list[tuple[int, int]], list[float]]:
        """Byte-pair encoding of a text by repeated best merges: spans, and the ranks merged."""
        starts, ranks = list(range(len(text))), []
        ends = [i + 1 for i in starts]
        right, left = [i + 1 for i in starts], [i - 1 for i in starts]
        alive, heap = [True] * len(text), []

        def offer(i: int) -> None:
            j = right[i]
            if j < len(text) and text[i : ends[j]] in self.ids:
                heapq.heappush(heap, (-self.pieces[self.ids[text[i : ends[j]]]][1], i, ends[j]))

        for i in starts[:-1]:
            offer(i)
        while heap:
            rank, i, end = heapq.heappop(heap)
            j = right[i] if alive[i] else len(text)
            if j >= len(text) or ends[j] != end:
                continue
            ranks.append(rank)
            ends[i], alive[j], right[i] = end, False, right[j]
            if right[j] < len(text):
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [(i, ends[i]) for i in starts if alive[i]], ranks

    def check(self) -> None:
        """Refuses byte-pair models whose merges can't be replayed in order of rank."""
        for p in self.ids if self.kind == BPE else ():
            spans, ranks = self.merged(p)
            if len(spans) != 1 or ranks != sorted(ranks):
                raise ValueError(f"piece {p!r} isn't built from pieces of better rank")


def read_model(path: str) -> Model:
    """A SentencePiece model file of the unigram or byte-pair kind with identity normalisation."""
    pieces, kind, prefix = [], UNIGRAM, True
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            d = dict(_fields(value))
            pieces.append((d[1].decode().replace("▁", " "), struct.unpack("<f", d.get(2, b"\0\0\0\0"))[0], d.get(3, NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            d = dict(_fields(value))
            prefix = bool(d.get(3, 1))
            if d.get(2) or d.get(4, 1) or not d.get(5, 1):
                raise ValueError("only identity normalisation that keeps white space is supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"model kind {kind} isn't supported")
    model = Model(pieces, kind, prefix)
    model.check()
    return model


def normalised(column: pa.Array, prefix: bool) -> pa.Array:
    """Texts with plain spaces for the escaped ones and the dummy prefix; null is empty."""
    text = pc.replace_substring(column.cast(pa.large_string()).fill_null(""), "▁", " ")
    if not prefix:
        return text
    front = pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    return pc.binary_join_element_wise(front, text, pa.scalar("", pa.large_string()))


def text_slices(column: pa.Array, prefix: bool, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """slices() of the normalised texts; only a slice at a time is normalised."""
    for lo, hi, _, _ in slices(column, limit):
        data, offsets = buffers(normalised(column.slice(lo, hi - lo), prefix))
        yield lo, hi, data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut(data: np.ndarray, offsets: np.ndarray, together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of segments (with the end of the last), and the first segment of each row."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    new = np.empty(len(data), bool)
    new[0] = True
    new[1:] = ~together[data[:-1], data[1:]]
    new[offsets[offsets < len(data)]] = True
    starts = np.append(np.flatnonzero(new), len(data))
    return starts, np.searchsorted(starts, offsets)


def distinct_segments(texts: DataFrame, model: Model) -> DataFrame:
    """(s, c): segments and how often they occur."""
    together, prefix = model.together, model.prefix

    def make():
        kernel = Kernel(lower=False)

        def merged(parts: list[tuple]) -> dict:
            """Segments of several slices, each once: (hashes, counts, bytes, offsets) by slice."""
            h, at, of = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            n = np.concatenate([np.diff(p[3]) for p in parts])
            first = np.append(0, np.cumsum(n))
            flat, ends = gather(first, np.concatenate([p[2] for p in parts]), at)
            names = pa.StringArray.from_buffers(len(h), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))
            return {"s": names, "c": pa.array(np.bincount(of, np.concatenate([p[1] for p in parts])).astype(np.int64))}

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            parts: list[tuple] = []
            for _, _, data, offsets in text_slices(batch["text"], prefix):
                starts, _ = cut(data, offsets, together)
                if len(starts) > 1:
                    h, at, c = np.unique(kernel.spans(kernel.prefix(data), starts[:-1], starts[1:]), return_index=True, return_counts=True)
                    parts.append((h, c, *gather(starts, data, at)))
                if len(parts) == 12:  # bounded: some MB of texts
                    yield merged(parts)
                    parts = []
            if parts:
                yield merged(parts)

        return step

    return map_batches(texts.select("text"), make, "s string, c long").groupBy("s").agg(F.sum("c").alias("c"))


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, cost, rank): the vocabulary, of fixed size. rank: place of the cost among the different costs, from 1."""
    costs = {c: i + 1 for i, c in enumerate(sorted({-model.pieces[i][1] for i in model.ids.values()}))}
    own = [-model.pieces[i][1] for i in model.ids.values()]
    return spark.createDataFrame(pa.table({"piece": list(model.ids), "id": pa.array(model.ids.values(), pa.int32()), "cost": own, "rank": pa.array([costs[c] for c in own], pa.int64())}))


def lattice(segments: DataFrame, model: Model) -> DataFrame:
    """(s, c, n, edges): every substring of a segment that is a piece, and every single character (id NONE if it has no piece).

    For byte-pair models an edge is one long, rank << 45 | begin << 23 | length << 17 | id, so that edges sort by rank, then begin, then end; single characters have rank 0. For unigram models it is a struct (cost, b, e, id).
    """
    sized = segments.withColumn("n", F.char_length("s"))
    spans = sized.select("s", "c", "n", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > HUGE, 0).otherwise(F.col("n") - 1))).alias("b")).select("s", "c", "n", "b", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), F.col("n") - F.col("b")))).alias("len"))
    found = spans.withColumn("piece", F.expr("substring(s, b + 1, len)")).join(F.broadcast(piece_table(segments.sparkSession, model)), "piece", "left").where("id is not null or len = 1")
    if model.kind == BPE:
        edge = F.expr(f"shiftleft(if(len = 1, 0L, rank), 45) | shiftleft(cast(b as bigint), 23) | shiftleft(cast(len as bigint), 17) | cast(coalesce(id, {NONE}) as bigint)")
    else:
        edge = F.expr(f"named_struct('cost', coalesce(cast(round(cost * {UNIT}) as bigint), {model.worst()}L), 'b', b, 'e', b + len, 'id', coalesce(id, {NONE}))")
    return found.groupBy("s", "c", "n").agg(F.collect_list(edge).alias("edges"))


def _ids(model: Model, path: str) -> Column:
    """Ids of a path, an array of begin << 17 | id in order; an unknown character gives its bytes, or the unknown id."""
    if model.byte0 is None:
        return F.expr(f"transform({path}, x -> cast(if(x & {NONE} = {NONE}, {model.unknown}, x & {NONE}) as int))")
    char = "substring(s, cast(shiftright(x, 17) as int) + 1, 1)"
    known = f"transform({path}, x -> cast(x & {NONE} as int))"
    bytes_ = f"flatten(transform({path}, x -> if(x & {NONE} < {NONE}, array(cast(x & {NONE} as int)), transform(sequence(1, octet_length({char})), k -> cast(conv(substring(hex({char}), 2 * k - 1, 2), 16, 10) as int) + {model.byte0}))))"
    return F.expr(f"if(exists({path}, x -> x & {NONE} = {NONE}), {bytes_}, {known})")


def merge_fold(lat: DataFrame, model: Model) -> DataFrame:
    """(s, c, ids, edges) by merges in order of rank; the state is the set of boundaries, a bit each. Segments with more boundaries than a long has bits, and those in which pieces of equal rank compete, have no ids yet and keep their edges for long_path()."""
    ranks = Counter(r["rank"] for r in piece_table(lat.sparkSession, model).select("rank").collect())  # the vocabulary
    tied = ", ".join(f"{r}L" for r, k in ranks.items() if k > 1) or "null"  # whose turn it is depends on the state
    out = lat.withColumn("edges", F.sort_array("edges")).withColumn("plain", F.expr(f"n <= {LONG} and size(filter(edges, x -> shiftright(x, 45) in ({tied}))) < 2"))
    begin, length = "cast(shiftright(x, 23) & 63 as int)", "cast(shiftright(x, 17) & 63 as int)"
    # z: the bits of an edge's ends, m: those of the boundaries inside it
    out = out.withColumn("parts", F.expr(f"if(plain, transform(edges, x -> named_struct('z', shiftleft(shiftleft(1L, {length}) | 1L, {begin}), 'm', shiftleft(shiftleft(1L, {length}) - 2L, {begin}), 'p', shiftright(x, 6) & {0x7E0000} | x & {NONE})), null)"))
    out = out.withColumn("at", F.expr("aggregate(parts, shiftleft(1L, n + 1) - 1L, (at, x) -> if((at & x.z) = x.z and bit_count(at & x.m) = 1, at & ~x.m, at))"))
    out = out.withColumn("path", F.expr("sort_array(transform(filter(parts, x -> (at & x.z) = x.z and (at & x.m) = 0), x -> x.p))"))
    return out.select("s", "c", F.when(F.col("plain"), _ids(model, "path")).alias("ids"), F.expr("if(plain, null, edges)").alias("edges"))


def long_path(s: str, edges: list[int], model: Model) -> list[int]:
    """The merges of a long segment, or of one with pieces of equal rank, by a queue of the segment's edges."""
    n = len(s)
    cost = {((x >> 23) & 0x3FFFFF, ((x >> 23) & 0x3FFFFF) + ((x >> 17) & 63)): (x >> 45, x & NONE) for x in edges}
    ends, before, alive, queue = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n + [False], []

    def offer(b: int) -> None:
        if ends[b] < n and (b, ends[ends[b]]) in cost:
            heapq.heappush(queue, (cost[b, ends[ends[b]]][0], b, ends[ends[b]]))

    for b in range(n - 1):
        offer(b)
    while queue:
        _, b, e = heapq.heappop(queue)
        mid = ends[b]
        if not alive[b] or mid >= n or ends[mid] != e:
            continue
        alive[mid], ends[b] = False, e
        if e < n:
            before[e] = b
        offer(b)
        if before[b] >= 0:
            offer(before[b])
    out: list[int] = []
    for b in range(n):
        if alive[b]:
            one = cost.get((b, ends[b]), (0, NONE))[1]
            if one != NONE:
                out.append(one)
            elif model.byte0 is None:
                out.append(model.unknown)
            else:
                out += [model.byte0 + k for k in s[b].encode()]
    return out


def whole_ids(s: str, model: Model) -> list[int]:
    """Ids of a segment that is too long for a row of edges: Model.merged(), or Viterbi over its pieces."""
    if model.kind == BPE:
        spans = model.merged(s)[0]
    else:
        worst = model.worst()
        best: list[tuple[int, int]] = [(0, 0)] + [(1 << 62, 0)] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - model.longest), e):
                one = model.ids.get(s[b:e])
                if one is None and e - b > 1:
                    continue
                total = best[b][0] + (worst if one is None else round(-model.pieces[one][1] * UNIT))
                if total < best[e][0]:
                    best[e] = (total, b)
        spans, e = [], len(s)
        while e:
            spans.append((best[e][1], e))
            e = best[e][1]
        spans.reverse()
    out: list[int] = []
    for b, e in spans:
        one = model.ids.get(s[b:e])
        out += [one] if one is not None else [model.unknown] if model.byte0 is None else [model.byte0 + k for k in s[b:e].encode()]
    return out


def viterbi_fold(lat: DataFrame, model: Model) -> DataFrame:
    """(s, c, ids, edges: null) by the path of least cost; the state is the best way to reach each position, ties go to the longer last piece."""
    reach = f"named_struct('cost', x.cost + best[x.b].cost, 'b', x.b, 'p', shiftleft(cast(x.b as bigint), 17) | x.id)"
    start = f"transform(sequence(0, n), i -> named_struct('cost', if(i = 0, 0L, {1 << 62}L), 'b', 0, 'p', {NONE}L))"
    ordered = "array_sort(edges, (l, r) -> case when l.e <> r.e then l.e - r.e else l.b - r.b end)"
    best = f"aggregate({ordered}, {start}, (best, x) -> if(best[x.b].cost + x.cost < best[x.e].cost, transform(best, (v, i) -> if(i = x.e, {reach}, v)), best))"
    walked = "aggregate(sequence(1, n), named_struct('at', n, 'path', cast(array() as array<bigint>)), (w, i) -> if(w.at = 0, w, named_struct('at', best[w.at].b, 'path', concat(array(best[w.at].p), w.path))), w -> w.path)"
    return lat.withColumn("best", F.expr(f"if(n <= 512, {best}, null)")).withColumn("path", F.expr(f"if(n <= 512, {walked}, null)")).select("s", "c", _ids(model, "path").alias("ids"), F.lit(None).cast("array<long>").alias("edges"))


def dictionary(texts: DataFrame, model: Model) -> DataFrame:
    """(key, c, ids) of every distinct segment, stored; key is the segment's hash."""
    segments = stored(distinct_segments(texts, model))
    segments = segments.repartition(max(1, min(1 << 15, -(-segments.count() // TASK))), "s")  # small tasks: a segment has tens of edges
    folded = (merge_fold if model.kind == BPE else viterbi_fold)(lattice(segments, model), model)

    def make():
        kernel = Kernel(lower=False)

        def step(batch: pa.RecordBatch) -> dict:
            keys = [kernel.spans(kernel.prefix(data), offsets[:-1], offsets[1:]) for _, _, data, offsets in slices(batch["s"])]
            ids = batch["ids"]
            if ids.null_count:
                ids = pa.array([x if x is not None else long_path(s, e, model) if e is not None and len(s) <= HUGE else whole_ids(s, model) for x, s, e in zip(ids.to_pylist(), batch["s"].to_pylist(), batch["edges"].to_pylist())], pa.list_(pa.int32()))
            return {"key": pa.array(np.concatenate(keys).view(np.int64)), "c": batch["c"], "ids": ids}

        return step

    return stored(map_batches(folded, make, "key long, c long, ids array<int>"))


@dataclass
class Lookup:
    """Ids of segments by hash: a table over flat arrays."""

    table: Table
    first: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(words: DataFrame, small: bool, ranges: int = 8) -> Lookup:
        """From rows (key, ids), collected one range of keys after the other, so that the driver holds little beside the table itself."""
        keys, sizes, flat = [], [], []
        top = F.shiftrightunsigned("key", 61)
        for i in range(ranges):
            rows = words.where((top * ranges / 8).cast("int") == i).select("key", F.col("ids").cast("array<int>").alias("ids")).toArrow()
            parts = rows["ids"].chunks or [pa.array([], pa.list_(pa.int32()))]
            n = np.concatenate([np.diff(p.offsets.to_numpy()).astype(np.int32) for p in parts])
            own = np.concatenate([p.flatten().to_numpy(zero_copy_only=False).astype(np.uint16 if small else np.int32) for p in parts])
            k = rows["key"].to_numpy().view(np.uint64)
            del rows, parts
            order = np.argsort(k)
            at = np.append(0, np.cumsum(n))
            keys.append(k[order]), sizes.append(n[order]), flat.append(gather(at, own, order)[0])
        n = np.concatenate(sizes)
        first = np.zeros(len(n) + 1, np.int32)  # fewer than 2^31 ids: bounded by the table's bytes
        np.cumsum(n, out=first[1:])
        return Lookup(Table(np.concatenate(keys)), first, np.concatenate(flat))


def hot_lookup(words: DataFrame, small: bool, most: int = HOT) -> tuple[Lookup, int | None]:
    """A table of the most frequent segments, of `most` bytes at most, and the least count that is in (None: all are)."""
    size = F.sum(F.lit(16) + F.size("ids") * (2 if small else 4))  # key, offset, directory, ids
    histogram = words.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(size.alias("n")).collect()  # 64 rows at most
    kept, least = 0, None
    for b, k in sorted(((r[0], r[1]) for r in histogram), reverse=True):
        if kept + k > most:
            return Lookup.of(words.where(F.col("c") >= (least or 1 << 62)), small), least or 1 << 62
        kept, least = kept + k, 1 << b
    return Lookup.of(words, small), None


def gather(first: np.ndarray, flat: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs flat[first[p]:first[p + 1]] of all places in order, and the runs' offsets."""
    n = first[places + 1] - first[places]
    at = np.zeros(len(places) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    return flat[np.repeat(first[places] - at[:-1], n) + np.arange(at[-1])], at


def joined(ids: np.ndarray, rows: np.ndarray, unknown: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the unknown ids that follow another one in their row left out, as the library does, and the rows' offsets; unknown: None if the model spells unknown characters as bytes."""
    if unknown is None or not len(ids):
        return ids, rows
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == unknown) & (ids[:-1] == unknown)
    again[rows[rows < len(ids)]] = False
    return ids[~again], np.append(0, np.cumsum(~again))[rows]


class Decoder:
    """Texts of id sequences: flat piece bytes, gathered."""

    def __init__(self, model: Model) -> None:
        raw = [bytes([i - model.byte0]) if t == BYTE else b"" if t == CONTROL else p.encode() if t != UNKNOWN else " ⁇ ".encode() for i, (p, _, t) in enumerate(model.pieces)]
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.first = np.append(0, np.cumsum([len(x) for x in raw]))
        self.prefix = model.prefix

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        data, at = gather(self.first, self.flat, ids)
        raw, ends = data.tobytes(), at[offsets]
        out = [raw[i:j].decode("utf-8", "replace") for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return [x[1:] if self.prefix and x.startswith(" ") else x for x in out]


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """The rows with their other columns and text for ids; null ids give null."""
    names = [c for c in encoded.columns if c not in ("ids", "text")]
    schema = ", ".join([*(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names), "text string"])

    def make():
        decoder = Decoder(model)

        def step(batch: pa.RecordBatch) -> dict:
            ids = batch["ids"]
            texts = decoder.texts(ids.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
            return {c: batch[c] for c in names} | {"text": pa.array([t if v else None for t, v in zip(texts, ids.is_valid().to_pylist())], pa.string())}

        return step

    return map_batches(encoded.select(*names, "ids"), make, schema)


def encode(documents: DataFrame, model: Model, most: int = HOT) -> DataFrame:
    """doc_id, ids for every row."""

    def emit(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> dict:
        return {"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))}

    return _encoded(documents, model, lambda: emit, "doc_id long, ids array<int>", most)


def _encoded(documents: DataFrame, model: Model, make_emit, schema: str, most: int) -> DataFrame:
    """What emit(doc ids, ids of all rows, their offsets) makes of the rows, slice by slice."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, together, prefix = docs.sparkSession, model.together, model.prefix
    unknown = model.unknown if model.byte0 is None else None
    words = dictionary(docs, model)
    hot, least = hot_lookup(words, len(model.pieces) <= 1 << 16, most)
    shared = spark.sparkContext.broadcast(hot)

    def segments(batch: pa.RecordBatch, kernel: Kernel):
        for lo, hi, data, offsets in text_slices(batch["text"], prefix):
            starts, first = cut(data, offsets, together)
            keys = kernel.spans(kernel.prefix(data), starts[:-1], starts[1:])
            yield lo, hi, keys, first, shared.value.table.find(keys)

    if least is None:
        docs = docs.withColumn("tail", F.lit(None).cast("array<struct<key: long, ids: array<int>>>"))
    else:

        def make_tail():
            kernel = Kernel(lower=False)

            def step(batch: pa.RecordBatch) -> Iterator[dict]:
                for lo, _, h, first, place in segments(batch, kernel):
                    cold = np.flatnonzero(place < 0)
                    row = np.searchsorted(first, cold, "right") - 1
                    pairs = np.unique(np.stack([row.astype(np.uint64), h[cold]]), axis=1)
                    yield {"doc_id": batch["doc_id"].take(pa.array(lo + pairs[0].astype(np.int64))), "key": pa.array(pairs[1].view(np.int64))}

            return step

        tails = map_batches(docs, make_tail, "doc_id long, key long").join(words.select("key", "ids"), "key")
        tails = tails.groupBy("doc_id").agg(F.collect_list(F.struct("key", "ids")).alias("tail")).withColumnRenamed("doc_id", "id")
        docs = docs.join(tails, F.col("doc_id").eqNullSafe(F.col("id")), "left").drop("id")

    def make():
        kernel, emit = Kernel(lower=False), make_emit()

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            hot = shared.value
            for lo, hi, keys, first, place in segments(batch, kernel):
                cold = np.flatnonzero(place < 0)
                if not len(cold):
                    ids, at = gather(hot.first, hot.ids, place)
                else:
                    known = {t["key"]: t["ids"] for i in range(lo, hi) for t in batch["tail"][i].as_py() or ()}
                    extra = [known[k] for k in keys[cold].view(np.int64).tolist()]
                    flat = np.concatenate([hot.ids, np.array([x for e in extra for x in e], dtype=hot.ids.dtype)])
                    more = np.concatenate([hot.first, hot.first[-1] + np.cumsum([len(e) for e in extra])])
                    place[cold] = len(hot.first) - 1 + np.arange(len(cold))
                    ids, at = gather(more, flat, place)
                yield emit(batch["doc_id"].slice(lo, hi - lo), *joined(ids.astype(np.int32), at[first], unknown))

        return step

    return map_batches(docs.select("doc_id", "text", "tail"), make, schema)


def encode_digests(documents: DataFrame, model: Model, most: int = HOT) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_chars and text_crc32 of the text that the ids decode to, ids: encoding and decoding in one pass over the texts."""

    def make_emit():
        decoder = Decoder(model)

        def emit(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> dict:
            raw, ends, texts = ids.astype("<u4"), at.tolist(), decoder.texts(ids, at)
            return {
                "doc_id": doc_ids,
                "n_tokens": pa.array(np.diff(at)),
                "ids_crc32": pa.array([zlib.crc32(raw[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:])], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "text_crc32": pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
            }

        return emit

    return _encoded(documents, model, make_emit, "doc_id long, n_tokens long, ids_crc32 long, n_chars long, text_crc32 long, ids array<int>", most)
