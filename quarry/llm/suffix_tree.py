"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are words (A-Z lower-cased) and one end mark a document. The tree holds every sequence of up to four symbols (a start mark included) that occurs LEAST times in the training documents; its contexts are sequences of up to three. LEAST is a fixed count, so what is learned grows with the corpus.
A context is retained if a divergence test finds that its next-symbol distribution differs from that of its longest retained suffix by more nats over the corpus than its parameters cost. Distributions are smoothed towards the suffix's: P(s|c) = (N(c,s) + (N(c) - N'(c) + T(c)) P(s|suffix)) / (N(c) + T(c)), with N' and T the count and number of the kept next symbols. The root gives known symbols (1 - u) c / N and the unknown symbol u, the share of tokens that occur once.
A token is scored in the longest retained state of its past.

All suffixes and prefixes of a sequence in the tree are in the tree, so a document's score is a sum over its sequences: the root's log P of each token, and for each sequence x in the tree a weight, log P(x) - log P(suffix of x) - B(prefix of x) if its prefix is retained, plus B(x), the log weight of the suffix in x if x is retained as a context.
Counts and weights are stored tables that meet documents by key, 64-bit hashes of the sequences. They are stored and shuffled as packed ranges of keys: a row has many keys as bytes. Counts of the K most frequent tokens and weights of the K most frequent sequences are broadcast (K = 2^22 at most, by a threshold over a histogram of 128 numbers), and a bit table of fixed size, which spares sequences that can't be in a table the shuffle.

Defined cases: null and empty texts are one end mark; with no training documents every token is unknown with probability 1; repeated rows are scored each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, map_batches, tidy, trim
from quarry.llm.kernel import Kernel, Table, mix, slices
from quarry.session import drop_stored, stored

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
LEAST = 2
DEPTH = 3
FILTER_BITS = 27
HOT = 1 << 22
FINE = 64  # counts below are told apart where HOT cuts
SLICE = 1 << 17  # bytes of text whose arrays stay in a core's cache
PART = 3 << 19  # keys that a task counts at a time
RARE = 3 << 17  # keys that a task sends at a time to meet their weights
COST = 3.0  # nats that each parameter of a retained context must save


def tokens(column: pa.Array, kernel: Kernel):
    """(first row, end row, token hashes, first token of each row) by slices; each row ends with END."""
    for lo, hi, data, offsets in slices(column, SLICE):
        h, first = kernel.word_hashes(data, offsets)
        at = first + np.arange(len(first))
        out = np.empty(len(h) + hi - lo, np.uint64)
        ends = at[1:] - 1
        words = np.ones(len(out), bool)
        words[ends] = False
        out[words], out[ends] = h, END
        yield lo, hi, out, at


def ordered(keys: np.ndarray) -> np.ndarray:
    """argsort of 64-bit hashes: their upper bits are sorted with the places in the lower ones, which takes a fraction of argsort's time."""
    keys = keys.view(np.uint64)
    bits = np.uint64(max(1, len(keys).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = keys & ~low
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    now = keys[order]
    wrong = np.flatnonzero(now[1:] < now[:-1])
    upper = now >> bits if len(wrong) else now
    for u in np.unique(upper[1:][wrong]):  # different keys with equal upper bits: few
        lo, hi = np.searchsorted(upper, u, "left"), np.searchsorted(upper, u, "right")
        order[lo:hi] = order[lo:hi][np.argsort(keys[order[lo:hi]], kind="stable")]
    return order


def starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


@dataclass
class Tree:
    """The tree in memory, for less than 2^20 symbols: frequent sequences by length. symbols: sorted hashes; levels[L - 2]: sorted keys (prefix node << 20 | symbol) of sequences of length L; the start mark is symbol len(symbols)."""

    symbols: np.ndarray
    root_share: np.ndarray | None = None  # P of each symbol (1 for the start mark) at the root
    levels: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)  # of the last symbol after the rest, for sequences of length L >= 2
    log_back: list[np.ndarray] = field(default_factory=list)  # weight of the suffix in a context of length L >= 1
    retained: list[np.ndarray] = field(default_factory=list)

    def nodes(self, h: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
        """Node of the sequence of each length that ends at each position, -1 if it isn't frequent. A start mark stands before each row."""
        rows = len(at) - 1
        sym = np.full(len(h) + rows, len(self.symbols), np.int64)
        body = np.ones(len(sym), bool)
        body[at[:-1] + np.arange(rows)] = False
        sym[body] = lookup(self.symbols, h)
        out = [sym]
        for keys in self.levels[: depth - 1]:
            last = out[-1]
            before = np.full(len(sym), -1)
            before[1:] = last[:-1]
            ok = np.flatnonzero((before >= 0) & (sym >= 0) & (last >= 0) & body)  # both parts are frequent
            node = np.full(len(sym), -1)
            node[ok] = lookup(keys, (before[ok] << 20) | sym[ok])
            out.append(node)
        return [*out, body]


def _count(documents: DataFrame, make) -> DataFrame:
    return map_batches(documents.select("text"), make, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def token_counts(documents: DataFrame) -> DataFrame:
    """(key, c): count of every token hash."""
    bits = range_bits(documents.sparkSession)

    def make():
        kernel = Kernel()

        def step(batch: pa.RecordBatch) -> dict:
            h = np.sort(np.concatenate([t for _, _, t, _ in tokens(batch["text"], kernel)]))
            at = starts(h)
            return deal({"key": h[at], "c": np.diff(np.append(at, len(h)))}, h[at], bits, True)

        return step

    def summed(rows: dict) -> dict:
        key, c = added(rows["key"], rows["c"])
        return {"key": key, "c": c}

    return met(map_batches(documents.select("text"), make, dealt_schema(["key", "c"])), summed, "key long, c long", bits)


def sequence_counts(documents: DataFrame, tree: Tree, length: int) -> DataFrame:
    """(key, c) of sequences of this length whose prefix and suffix are frequent."""
    shared = documents.sparkSession.sparkContext.broadcast(tree)

    def make():
        kernel = Kernel()

        def step(batch: pa.RecordBatch) -> dict | None:
            parts = []
            for _, _, h, at in tokens(batch["text"], kernel):
                *nodes, body = shared.value.nodes(h, at, length - 1)
                last, sym = nodes[-1], nodes[0]
                ok = np.flatnonzero((last[:-1] >= 0) & (last[1:] >= 0) & body[1:])
                parts.append((last[ok] << 20) | sym[ok + 1])
            key, c = np.unique(np.concatenate(parts), return_counts=True)
            return {"key": pa.array(key), "c": pa.array(c)} if len(key) else None

        return step

    return _count(documents, make)


def grow(tree: Tree, counts: list[np.ndarray]) -> None:
    """Fills the tree's probabilities from the counts of its sequences, length by length; counts[0]: of the symbols and the start mark."""
    n_symbols = len(tree.symbols)
    suffix = [np.full(n_symbols + 1, -1)]  # node of each sequence's suffix
    paths: list[list[tuple]] = [[(i,) for i in range(n_symbols + 1)]]
    for L, keys in enumerate(tree.levels, 2):
        place = {p: i for i, p in enumerate(paths[-1])}
        own = [(*paths[-1][k >> 20], k & 0xFFFFF) for k in keys.tolist()]
        suffix.append(np.array([place.get(p[1:], -1) for p in own], dtype=np.int64))
        paths.append(own)
    chance = [tree.root_share]  # P of the last symbol, by node
    for L, keys in enumerate(tree.levels, 2):
        context, sym = keys >> 20, keys & 0xFFFFF
        n_context = len(counts[L - 2])
        c = counts[L - 1].astype(float)
        n = counts[L - 2].astype(float)
        kept, kinds = np.bincount(context, c, n_context), np.bincount(context, minlength=n_context).astype(float)
        back = (np.maximum(n - kept, 0) + kinds) / np.maximum(n + kinds, 1)
        # P(sym | longest retained suffix of the context)
        lower = np.zeros(len(keys))
        scale, open_ = np.ones(len(keys)), np.ones(len(keys), bool)
        ctx, shorter = context.copy(), suffix[L - 1].copy()
        for l in range(L - 1, 0, -1):  # shorter: the sequence's last l symbols; their context has length l - 1
            if l == 1:
                lower[open_] = scale[open_] * chance[0][sym[open_]]
                break
            ctx = suffix[l - 1][ctx]
            keep = open_ & tree.retained[l - 2][ctx]
            hit = keep & (shorter >= 0)
            lower[hit] = scale[hit] * np.exp(tree.log_p[l - 2][shorter[hit]])
            open_ &= ~hit
            miss = keep & ~hit
            scale[miss] *= np.exp(tree.log_back[l - 2][ctx[miss]])
            shorter = np.where(shorter >= 0, suffix[l - 1][np.maximum(shorter, 0)], -1)
        p = (c + back[context] * (n + kinds)[context] * lower) / (n + kinds)[context]
        gain = np.bincount(context, p * np.log(p / np.maximum(lower, 1e-300)), n_context)
        rest = np.maximum(1 - np.bincount(context, p, n_context), 0)
        divergence = gain + rest * np.log(np.maximum(back, 1e-300))
        tree.retained.append((kinds > 0) & (n * divergence >= COST * (kinds + 1)))
        tree.log_p.append(np.log(p))
        tree.log_back.append(np.log(np.maximum(back, 1e-300)))
        chance.append(p)


def root(documents: DataFrame) -> tuple[DataFrame, dict]:
    """The table of all tokens' counts, and N, V and u."""
    counts = stored(token_counts(documents))
    n, v, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    return counts, {"n": n, "v": v, "u": min(max(once / max(n, 1), 1 / (n + v + 1)), 0.5) if n else 1.0}


def train(documents: DataFrame, depth: int = DEPTH, p_min: float = 0.0) -> tuple[Tree, DataFrame, dict]:
    """The tree in memory, the table of all tokens' counts, and N, V and u. documents: the training rows. score() doesn't need it: it is what weights() is compared with."""
    counts, stats = root(documents)
    n = stats["n"]
    least = max(LEAST, p_min * n)
    rows = documents.count() if n else 0
    frequent = counts.where((F.col("c") >= least) | (F.col("key") == F.lit(int(END.view(np.int64))))).toArrow()
    if frequent.num_rows >= 1 << 20:
        raise ValueError("too many symbols for a tree in memory")
    h, c = frequent["key"].to_numpy().view(np.uint64), frequent["c"].to_numpy()
    order = np.argsort(h)
    tree = Tree(h[order])
    tree.root_share = np.append((1 - stats["u"]) * c[order] / max(n, 1), 1.0)
    levels = [np.append(c[order], rows)]
    for length in range(2, depth + 2):
        if not n:
            break
        found = sequence_counts(documents, tree, length).where(F.col("c") >= least).toArrow()
        key, c = found["key"].to_numpy(), found["c"].to_numpy()
        if not len(key):
            break
        order = np.argsort(key)
        tree.levels.append(key[order])
        levels.append(c[order])
    grow(tree, levels)
    return tree, counts, stats


def sequences(h: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 1: places of the last symbol, keys, and keys of the prefix and the suffix (none for length 1) of all sequences, with a start mark before each row."""
    n = np.diff(at) + 1
    before = np.arange(len(h) + len(n)) - np.repeat(at[:-1] + np.arange(len(n)), n)
    key = np.full(len(before), START, np.uint64)
    key[before > 0] = h
    none = np.zeros(0, np.uint64)
    last, length = np.arange(len(before)), 1
    yield last, key, none, none
    while True:
        ok = before >= length
        ok[:1] = False
        ok = np.flatnonzero(ok)
        suffix, prefix = key[ok], key[ok - 1]
        last, before, length = last[ok], before[ok], length + 1
        key = joined_key(prefix, suffix, length)
        yield last, key, prefix, suffix


class Filter:
    """Bit table of keys: has() is true for all of them, and for few others while they are fewer than its bits. found: range, words: the bits of each range of keys."""

    def __init__(self, found: pa.Table, bits: int) -> None:
        self.words = np.zeros((1 << bits, 1 << (FILTER_BITS - 6 - bits)), np.uint64)
        for i, words in zip(found["range"].to_pylist(), found["words"]):
            self.words[i] |= np.frombuffer(words.as_buffer(), np.uint64)
        self.words = self.words.ravel()

    @classmethod
    def of(cls, packed: DataFrame, bits: int) -> Filter:
        """The keys of a packed table, which has each range once."""

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.to_pylist()
                if rows:
                    yield pa.RecordBatch.from_pydict({"range": pa.array([r["range"] for r in rows], pa.int32()), "words": pa.array([segment(np.frombuffer(r["key"], np.uint64), bits) for r in rows], pa.binary())})

        return cls(packed.select("range", "key").mapInArrow(words, "range int, words binary").toArrow(), bits)  # 2^FILTER_BITS bits in all

    def has(self, keys: np.ndarray) -> np.ndarray:
        word, own = place(keys)
        return (self.words[word] & own) == own


def place(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key's word in a filter, and its two bits there; its upper FILTER_BITS + 6 bits give them."""
    one, rest = np.uint64(1), np.uint64(63)
    own = one << ((keys >> np.uint64(64 - FILTER_BITS)) & rest)
    own |= one << ((keys >> np.uint64(58 - FILTER_BITS)) & rest)
    return (keys >> np.uint64(70 - FILTER_BITS)).astype(np.int64), own


def segment(keys: np.ndarray, bits: int) -> bytes:
    """The part of a filter that the sorted keys of one range fill."""
    out = np.zeros(1 << (FILTER_BITS - 6 - bits), np.uint64)
    word, own = place(keys)
    word &= len(out) - 1
    at = starts(word)
    if len(at):
        out[word[at]] = np.bitwise_or.reduceat(own, at)
    return out.tobytes()


def kind(column: str) -> type:
    """What a column's values are while they are bytes."""
    return np.float64 if column in ("q", "kq", "w", "kw", "base", "model") else np.int64


def range_bits(spark: SparkSession) -> int:
    """Bits of a range's number: about as many ranges as shuffle partitions. With 32 more bits of a key they are as many as place() reads, FILTER_BITS + 6."""
    return min(16, max(FILTER_BITS - 26, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, sorted, and the sums of its values."""
    order = ordered(key)
    key = key[order]
    at = starts(key)
    return (key[at], *(np.add.reduceat(v[order], at) if len(at) else v for v in values))


def deal(rows: dict[str, np.ndarray], by: np.ndarray, bits: int, is_sorted: bool = False) -> dict:
    """Columns as bytes, one row for each range of the hash `by`, sorted by it: a shuffle moves few rows, and equal hashes compress."""
    by = by.view(np.uint64)
    if not is_sorted:
        order = ordered(by)
        by, rows = by[order], {c: v[order] for c, v in rows.items()}
    cut = np.searchsorted(by, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    cut = np.concatenate([[0], cut, [len(by)]])
    own = np.flatnonzero(np.diff(cut))
    ends = (8 * np.append(cut[own], len(by))).astype(np.int32)
    out = {"range": pa.array(own.astype(np.int32))}
    for name, v in rows.items():
        out[name] = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(v.view(kind(name))))])
    return out


def dealt_schema(columns: list[str]) -> str:
    return ", ".join(["range int", *(f"{c} binary" for c in columns)])


def padded(part: dict, columns: list[str]) -> pa.RecordBatch:
    """Packed rows with all of these columns, null where they have none."""
    return pa.RecordBatch.from_pydict({c: part[c] if c in part else pa.nulls(len(part["range"]), pa.binary()) for c in ("range", *columns)})


def unpacked(rows: list[dict], columns: list[str]) -> dict:
    """The columns of packed rows as arrays."""
    return {c: np.concatenate([np.zeros(0, kind(c)), *(np.frombuffer(r[c], kind(c)) for r in rows if r[c] is not None)]) for c in columns}


def dealt(df: DataFrame, by: str, bits: int) -> DataFrame:
    """The rows of a table as deal() packs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chain(batches, (None,)):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if n and (batch is None or n > 1 << 20):
                rows = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_pydict(deal({c: rows[c].to_numpy() for c in rows.column_names}, rows[by].to_numpy(), bits))
                held, n = [], 0
        trim()

    return df.mapInArrow(run, dealt_schema(df.columns))


def each(df: DataFrame, make: Callable[[dict], dict], columns: list[str]) -> DataFrame:
    """Packed rows, row by row: make() of the columns' arrays."""
    names = df.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out = make(unpacked([r], names))
                yield pa.RecordBatch.from_pydict({"range": pa.array([r["range"]], pa.int32()), **{c: pa.array([out[c].tobytes()], pa.binary()) for c in columns}})
        trim()

    return df.mapInArrow(run, dealt_schema(columns))


def met(df: DataFrame, make: Callable[[dict], dict], out: str | list[list[str]], bits: int) -> DataFrame:
    """make() of the columns of all rows of each range. out: the schema of the rows that it gives; or groups of columns, each packed again by ranges of its first column."""
    columns = df.columns[1:]
    groups = [[c.split()[0] for c in out.split(", ")]] if isinstance(out, str) else out
    names = [c for g in groups for c in g]

    def given(held: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = {c: np.concatenate([x[c] for x in held]) for c in names}
        if not isinstance(out, str):
            for g in groups:
                if len(rows[g[0]]):
                    yield padded(deal({c: rows[c] for c in g}, rows[g[0]], bits), names)
            return
        batch = pa.RecordBatch.from_pydict({c: pa.array(v.view(kind(c))) for c, v in rows.items()})
        yield from (batch.slice(i, 1 << 16) for i in range(0, batch.num_rows, 1 << 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        ranges: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                ranges.setdefault(r.pop("range"), []).append(r)
        held, n = [], 0
        while ranges:
            held.append(make(unpacked(ranges.popitem()[1], columns)))
            n += max(len(held[-1][g[0]]) for g in groups)
            if n > 1 << 20 or not ranges:
                yield from given(held)
                held, n = [], 0
        trim()

    return df.repartition("range").mapInArrow(run, out if isinstance(out, str) else dealt_schema(names))


def joined_key(prefix: np.ndarray, suffix: np.ndarray, length: int) -> np.ndarray:
    """Key of the sequence of this length with these keys of its prefix and suffix."""
    return mix(prefix.view(np.uint64) * np.uint64(0x9FB21C651E98DF25) + mix(suffix.view(np.uint64) + np.uint64(length)))


def repeated(documents: DataFrame, depth: int) -> list[Broadcast]:
    """Broadcast filters of the sequences of each length from 2 to depth + 1 that may occur twice: they let through all that do. The driver has one of them at a time.

    In one pass tasks send 32 bits of each key that they see, sorted and by ranges of keys, with those that they see twice marked; a range's bits meet, and those that come twice or are marked set their place in the filter. Equal bits of different keys let more through, never less.
    """
    spark = documents.sparkSession
    bits = range_bits(spark)

    def make():
        kernel = Kernel()

        def sent(length: int, parts: list) -> dict:
            key = np.concatenate(parts)
            parts.clear()
            key.sort()
            at = starts(key)
            more = np.diff(np.append(at, len(key))) > 1
            key = key[at]
            cut = np.append(np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(key))
            short = ((key << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            own = np.flatnonzero(np.diff(cut))
            pick = lambda i, m: short[cut[i] : cut[i + 1]][m[cut[i] : cut[i + 1]]].tobytes()
            return {"length": pa.array(np.full(len(own), length, np.int32)), "range": pa.array(own.astype(np.int32)), "once": pa.array([pick(i, ~more) for i in own], pa.binary()), "more": pa.array([pick(i, more) for i in own], pa.binary())}

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            parts, held = [[] for _ in range(depth)], 0
            for _, _, h, at in chain(tokens(batch["text"], kernel), ((0, 0, None, None),)):
                if held and (h is None or held > PART):
                    for i, own in enumerate(parts):
                        yield sent(i + 2, own)
                    held = 0
                if h is not None:
                    for own, (_, key, _, _) in zip(parts, islice(sequences(h, at), 1, None)):
                        own.append(key)
                    held += len(h)

        return step

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        ranges: dict[tuple, list] = {}
        for b in batches:
            for r in b.to_pylist():
                ranges.setdefault((r["length"], r["range"]), []).append(r)
        while ranges:
            (length, i), rows = ranges.popitem()
            once = np.sort(np.concatenate([np.frombuffer(r["once"], np.uint32) for r in rows]))
            marked = np.sort(np.concatenate([once[1:][once[1:] == once[:-1]], *(np.frombuffer(r["more"], np.uint32) for r in rows)]))
            top = (np.uint64(i) << np.uint64(64 - bits)) | (marked.astype(np.uint64) << np.uint64(32 - bits))
            yield pa.RecordBatch.from_pydict({"length": pa.array([length], pa.int32()), "range": pa.array([i], pa.int32()), "words": pa.array([segment(top, bits)], pa.binary())})
        trim()

    rows = map_batches(documents.select("text"), make, "length int, range int, once binary, more binary")
    found = stored(rows.repartition("length", "range").mapInArrow(marks, "length int, range int, words binary"))
    del rows
    tidy(spark)  # the shuffle's files go before the counts' are written
    out = []
    for n in range(2, depth + 2):
        out.append(spark.sparkContext.broadcast(Filter(found.where(F.col("length") == n).select("range", "words").toArrow(), bits)))  # 2^FILTER_BITS bits
        trim()
    drop_stored(found)
    return out


def pair_counts(documents: DataFrame, filters: list[Broadcast], length: int, least: float) -> DataFrame:
    """Packed (at, prefix, c), by ranges of at, the suffix: the sequences of this length that occur so often. filters: those of repeated() for shorter sequences, if any, and for these: most of the sequences that occur once are left out before the shuffle."""
    bits = range_bits(documents.sparkSession)

    def make():
        kernel = Kernel()

        def counted(parts: list) -> dict:
            key, prefix, suffix = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = ordered(key)
            key = key[order]
            at = starts(key)
            first = order[at]
            del order
            return deal({"prefix": prefix[first], "suffix": suffix[first], "c": np.diff(np.append(at, len(key)))}, key[at], bits, True)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            parts, held = [], 0
            *shorter, often = (f.value for f in filters)
            for _, _, h, at in tokens(batch["text"], kernel):
                _, key, prefix, suffix = next(islice(sequences(h, at), length - 1, None))
                ok = np.flatnonzero(often.has(key))
                for f in shorter:
                    ok = ok[f.has(prefix[ok])]
                    ok = ok[f.has(suffix[ok])]
                parts.append((key[ok], prefix[ok], suffix[ok]))
                held += len(ok)
                if held > PART:
                    yield counted(parts)
                    held = 0
            if held:
                yield counted(parts)

        return step

    def summed(rows: dict) -> dict:
        order = ordered(key := joined_key(rows["prefix"], rows["suffix"], length))
        at = starts(key[order])
        c = np.add.reduceat(rows["c"][order], at) if len(at) else rows["c"]
        often = np.flatnonzero(c >= least)
        at = order[at[often]]
        return {"at": rows["suffix"][at], "prefix": rows["prefix"][at], "c": c[often]}

    return met(map_batches(documents.select("text"), make, dealt_schema(["prefix", "suffix", "c"])), summed, [["at", "prefix", "c"]], bits)


def with_level(rows: DataFrame, level: DataFrame, **values: str) -> DataFrame:
    """Packed rows and beside them k, the keys of a packed table, and these of its columns under other names."""
    return rows.unionByName(level.select("range", F.col("key").alias("k"), *(F.col(v).alias(c) for c, v in values.items())), allowMissingColumns=True)


def with_lower(rows: DataFrame, level: DataFrame, length: int, bits: int) -> DataFrame:
    """Packed (at, key, c, q), by ranges of at: prefix, key and count of each sequence, and P of its last symbol after its suffix's past."""

    def found(rows: dict) -> dict:
        known = rows["kq"] >= 0
        k, q = rows["k"][known], rows["kq"][known]
        order = ordered(k)
        at = lookup(k.view(np.uint64)[order], rows["at"].view(np.uint64))
        own = np.flatnonzero(at >= 0)
        prefix = rows["prefix"][own]
        return {"at": prefix, "key": joined_key(prefix, rows["at"][own], length).view(np.int64), "c": rows["c"][own], "q": q[order[at[own]]]}

    return met(with_level(rows, level, kq="q"), found, [["at", "key", "c", "q"]], bits)


def judged(rows: DataFrame, level: DataFrame, bits: int) -> DataFrame:
    """Packed (key, c, q, w), by ranges of key: the sequences with count, P of their last symbol and weight; and the retained contexts with minus the count, -1 and their weight."""

    def test(rows: dict) -> dict:
        known = rows["n"] > 0
        at, n = rows["k"][known], rows["n"][known]
        order = ordered(at)
        at, n = at[order], n[order].astype(float)
        of = lookup(at.view(np.uint64), rows["at"].view(np.uint64))
        own = np.flatnonzero(of >= 0)
        of = of[own]
        c, lower = rows["c"][own], rows["q"][own]
        kept, kinds = np.bincount(of, c, len(at)), np.bincount(of, minlength=len(at)).astype(float)
        back = (np.maximum(n - kept, 0) + kinds) / np.maximum(n + kinds, 1)
        p = (c + back[of] * (n + kinds)[of] * lower) / (n + kinds)[of]
        gain = np.bincount(of, p * np.log(p / lower), len(at))
        log_back = np.log(np.maximum(back, 1e-300))
        divergence = gain + np.maximum(1 - np.bincount(of, p, len(at)), 0) * log_back
        retained = (kinds > 0) & (n * divergence >= COST * (kinds + 1))
        w = np.where(retained[of], np.log(p) - np.log(lower) - log_back[of], 0.0)
        return {
            "key": np.concatenate([rows["key"][own], at[retained]]), "c": np.concatenate([c, -n[retained].astype(np.int64)]),
            "q": np.concatenate([np.where(retained[of], p, lower), np.full(retained.sum(), -1.0)]), "w": np.concatenate([w, log_back[retained]]),
        }

    return met(with_level(rows, level, n="c"), test, [["key", "c", "q", "w"]], bits)


def weights(documents: DataFrame, counts: DataFrame, stats: dict, depth: int = DEPTH, p_min: float = 0.0) -> DataFrame:
    """Stored packed (key, c, w), each range of keys in one row: count and weight of every sequence of the tree whose weight isn't 0. documents: the training rows."""
    spark, n = documents.sparkSession, stats["n"]
    bits = range_bits(spark)
    least = max(LEAST, p_min * n)
    level = counts.where((F.col("c") >= least) | (F.col("key") == F.lit(int(END.view(np.int64))))).select("key", "c", (F.col("c") * F.lit((1 - stats["u"]) / max(n, 1))).alias("q"))
    start = spark.createDataFrame([(int(START.view(np.int64)), documents.count(), 1.0)], "key long, c long, q double")
    level = stored(dealt(level.unionByName(start), "key", bits))
    tables = [level]
    filters = repeated(documents, depth) if n else []
    for length in range(2, depth + 2) if n else ():
        pairs = stored(pair_counts(documents, filters[max(0, length - 3) : length - 1], length, least))
        for f in filters[max(0, length - 3) : length - 2 + (length > depth)]:
            f.destroy()  # each executor has its copy on disk
        tidy(spark)  # the shuffle's files go before the next ones are written
        level = stored(judged(with_lower(pairs, level, length, bits), level, bits))
        tables.append(level)
        drop_stored(pairs)
        tidy(spark)

    def weighing(rows: dict) -> dict:
        own = rows["w"] != 0
        return {"key": rows["key"][own], "c": np.abs(rows["c"][own]), "w": rows["w"][own]}

    def merged(rows: dict) -> dict:
        order = ordered(rows["key"])
        key = rows["key"][order]
        at = starts(key)
        return {"key": key[at], "c": rows["c"][order][at], "w": np.add.reduceat(rows["w"][order], at) if len(at) else rows["w"]}

    own = [each(t.select("range", "key", "c", "w"), weighing, ["key", "c", "w"]) for t in tables[1:]]
    out = stored(met(reduce(DataFrame.unionByName, own or [spark.createDataFrame([], dealt_schema(["key", "c", "w"]))]), merged, [["key", "c", "w"]], bits))
    for done in tables:
        drop_stored(done)
    tidy(spark)
    return out


def low_end(c: np.ndarray) -> np.ndarray:
    """The count itself up to FINE, then the power of two below it."""
    return np.where(c < FINE, c, np.int64(1) << np.floor(np.log2(np.maximum(c, 1))).astype(np.int64))


def hot_from(packed: DataFrame, most: int = HOT) -> int:
    """The least count with at most `most` keys from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, k = np.unique(low_end(unpacked(b.to_pylist(), ["c"])["c"]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"b": pa.array(low), "k": pa.array(k)})

    histogram = packed.select("c").mapInArrow(run, "b long, k long").groupBy("b").agg(F.sum("k")).collect()  # FINE + 64 rows at most
    kept, least = 0, 1 << 62
    for b, k in sorted(((r[0], r[1]) for r in histogram), reverse=True):
        if kept + k > most:
            break
        kept, least = kept + k, b
    return least


def hot_table(packed: DataFrame, least: int, value: str, most: int = HOT) -> tuple[Table, np.ndarray]:
    """Table of the hashes and values of the rows with this count at least, which are `most` or fewer, and of the end mark. The driver gets them range by range, so that it has them once."""
    end = END.view(np.int64)

    def often(rows: dict) -> dict:
        own = (rows["c"] >= least) | (rows["key"] == end)
        return {"key": rows["key"][own], value: rows[value][own]}

    names = ["key", value]
    rows = stored(each(packed.select("range", *dict.fromkeys(["key", "c", value])), often, names))
    h, v, n = np.empty(most + 1, np.uint64), np.empty(most + 1, kind(value)), 0
    for _, own in groupby(rows.orderBy("range").toLocalIterator(), lambda r: r["range"]):
        part = unpacked([r.asDict() for r in own], names)
        order = ordered(part["key"])
        h[n : n + len(order)], v[n : n + len(order)] = part["key"].view(np.uint64)[order], part[value][order]
        n += len(order)
    drop_stored(rows)
    return Table(h[:n]), v[:n]


def score(documents: DataFrame, held_out_mod: int = 7, held_out_rest: int = 2, depth: int = DEPTH, p_min: float = 0.0, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trained = docs.where(crc_mod("doc_id", held_out_mod) != held_out_rest)
    bits = range_bits(spark)
    counts, stats = root(trained)
    weighted = weights(trained, counts, stats, depth, p_min)
    plain, counts = counts, stored(dealt(counts, "key", bits))
    drop_stored(plain)
    frequent, common = hot_from(counts, hot), hot_from(weighted, hot)
    shared = []  # one by one: the driver has one of them at a time
    for part in (lambda: hot_table(counts, frequent, "c", hot), lambda: hot_table(weighted, common, "w", hot), lambda: Filter.of(weighted, bits)):
        shared.append(spark.sparkContext.broadcast(part()))
        tidy(spark)
    n, v, u = stats["n"], stats["v"], stats["u"]
    log_u = float(np.log10(u))
    of_row = ["row", "doc", "known_id", "size", "known", "base", "model"]
    columns = ["xrow", "xkey", "trow", "tkey", *of_row]

    def make():
        kernel, ((tokens_table, hot_c), (sequence_table, hot_w), possible) = Kernel(), (b.value for b in shared)
        part, serial = TaskContext.get().partitionId() << 40, [0]

        def packed(ids: np.ndarray, rows: tuple, keys: tuple, names: list[str]) -> dict:
            """By ranges of keys, in each by rows: equal rows compress."""
            row, key = np.concatenate(rows), np.concatenate(keys)
            width, shift = np.uint64(len(key).bit_length()), np.uint64(64 - bits)
            order = np.sort(((key >> shift) * np.uint64(len(ids)) + row.astype(np.uint64)) << width | np.arange(len(key), dtype=np.uint64))
            order = (order & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
            row, key = row[order], key[order]
            return deal({names[0]: ids[row], names[1]: key}, key >> shift << shift, bits, True)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            ids = (part + serial[0] + np.arange(batch.num_rows)).astype(np.uint64)
            serial[0] += batch.num_rows
            whole, rare, cold, held = [], [], [], 0
            for lo, hi, h, at in tokens(batch["text"], kernel):
                rows = np.repeat(np.arange(hi - lo), np.diff(at))
                place = tokens_table.find(h)
                hit = place >= 0
                c = hot_c[place[hit]]
                base = np.bincount(rows[hit], np.log10(c + 1), hi - lo)
                model = np.bincount(rows[hit], np.log((1 - u) * c / max(n, 1)), hi - lo)
                cold.append((lo + rows[~hit], h[~hit]))
                marked = np.repeat(np.arange(hi - lo), np.diff(at) + 1)
                for last, key, _, _ in islice(sequences(h, at), depth + 1):
                    seen = np.flatnonzero(possible.has(key))
                    of, key = marked[last[seen]], key[seen]
                    found = sequence_table.find(key)
                    own = found >= 0
                    model += np.bincount(of[own], hot_w[found[own]], hi - lo)
                    rare.append((lo + of[~own], key[~own]))
                    held += len(of) - int(own.sum())
                whole.append((np.diff(at), np.bincount(rows, hit, hi - lo).astype(np.int64), base, model / np.log(10)))
                if held > RARE:
                    yield packed(ids, *zip(*rare), columns[:2])
                    rare, held = [], 0
            if held:
                yield packed(ids, *zip(*rare), columns[:2])
            if sum(len(x) for x, _ in cold):
                yield packed(ids, *zip(*cold), columns[2:4])
            doc = batch["doc_id"]
            values = [ids, doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), *(np.concatenate(x) for x in zip(*whole))]
            yield {"range": pa.array([int(mix(ids[:1])[0] >> np.uint64(64 - bits))], pa.int32()), **{c: pa.array([x.view(kind(c)).tobytes()], pa.binary()) for c, x in zip(of_row, values)}}

        def all_columns(batch: pa.RecordBatch) -> Iterator[dict]:
            for part_ in step(batch):
                full = padded(part_, columns)
                yield {c: full[c] for c in full.schema.names}

        return all_columns

    def summed(rows: dict) -> dict:
        """Rows as they are, their ids as hashes; of the keys that weren't broadcast, the sums of each row's."""
        rows |= {c: mix(rows[c].view(np.uint64)).view(np.int64) for c in ("row", "xrow", "trow")}
        order = ordered(rows["k"])
        at = lookup(rows["k"].view(np.uint64)[order], rows["xkey"].view(np.uint64))
        own = np.flatnonzero(at >= 0)
        xrow, w = added(rows["xrow"][own], rows["kw"][order[at[own]]])
        order = ordered(rows["ck"])
        at = lookup(rows["ck"].view(np.uint64)[order], rows["tkey"].view(np.uint64))
        own = at >= 0
        c = np.zeros(len(at))
        c[own] = rows["cc"][order[at[own]]]
        trow, known, base, model = added(rows["trow"], own.astype(np.int64), np.log10(c + 1), np.where(own, np.log10(np.where(own, c * ((1 - u) / max(n, 1)), 1.0)), log_u))
        none = np.zeros(len(trow), np.int64)
        more = {"row": trow, "doc": none, "known_id": none, "size": none, "known": known, "base": base, "model": model}
        return {"xrow": xrow, "w": w / np.log(10), **{c: np.concatenate([rows[c], more[c]]) for c in of_row}}

    def totals(rows: dict) -> dict:
        row, *values = added(*(rows[c] for c in of_row))
        out = dict(zip(of_row, [row, *values]))
        xrow, w = added(rows["xrow"], rows["w"])
        out["model"] = out["model"].copy()
        out["model"][lookup(row.view(np.uint64), xrow.view(np.uint64))] += w
        return out

    rarer = each(weighted, lambda r: {c: r[v][r["c"] < common] for c, v in (("key", "key"), ("kw", "w"))}, ["key", "kw"])
    colder = each(counts, lambda r: {c: r[v][r["c"] < frequent] for c, v in (("ck", "key"), ("cc", "c"))}, ["ck", "cc"])
    scored = with_level(map_batches(docs, make, dealt_schema(columns)), rarer, kw="kw").unionByName(colder, allowMissingColumns=True)
    out = met(met(scored, summed, [["xrow", "w"], of_row], bits), totals, ", ".join(f"{c} {'double' if kind(c) is np.float64 else 'long'}" for c in of_row), bits)
    result = stored(out.withColumn("doc_id", F.when(F.col("known_id") > 0, F.col("doc"))).select(
        "doc_id",
        (crc_mod("doc_id", held_out_mod) == held_out_rest).alias("held_out"),
        F.col("size").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("size") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        F.col("model").alias("score"),
    ))
    for b in shared:  # they would stay in the memory of the driver and the executors for as long as the result is in use
        b.destroy()
    for done in (counts, weighted):
        drop_stored(done)
    tidy(spark)
    return result
