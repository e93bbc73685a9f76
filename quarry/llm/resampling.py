"""Target-distribution importance resampling over hashed word n-grams, with overlap chunking of long texts.

Features of a text are its runs of 1 to n consecutive words (A-Z lower-cased; every ASCII byte but letters and digits separates words), joined by one space, repeats counted. A feature's bucket is the crc32 of its UTF-8 bytes modulo the number of buckets. A bucket's gain is the floored, scaled log-ratio of its smoothed shares among the target's and the documents' features; a document's weight is the floored mean gain of its features.
A weighted draw without replacement takes the highest sums of weight and Gumbel noise; the noise comes from a hash of the id, so a draw is repeatable.

Long texts are cut at word boundaries into chunks, which are stored and dealt out by themselves. A chunk owns the features that start in it and carries the next n - 1 words, so each feature is counted once; counts and gains of chunks are summed by document. Texts of one chunk are read where they are and aren't shuffled. A task adds up its bucket counts before they meet.
Ranks come from one range shuffle by (score, id): places within partitions plus the sizes of the partitions before, of which one number each reaches the driver.

crc32 is computed for all words of a slice at once, byte place by byte place; a run's crc follows from its words' by the linear rule for concatenation, without laying out the run's bytes.

Defined cases: null and empty texts have no features and weight 0; a null id hashes as the empty text and ranks first among equal scores; repeated rows are documents of their own (those of one id share the noise); an empty target or empty documents give counts of 0; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, trim
from quarry.llm.kernel import Kernel, buffers, slices
from quarry.session import stored

BUCKETS = 10_000
CHUNK_BYTES = 1 << 16
SHORT = 64  # bytes of a word up to which its crc is computed beside all others
NONE = np.uint32(0xFFFFFFFF)


class Crc:
    """Vectorised crc32 (the reflected polynomial 0xEDB88320); one per task."""

    def __init__(self) -> None:
        t = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
        self.table = t
        one = np.stack([self._zero(np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])
        self.near = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)]), one]
        while len(self.near) <= SHORT:
            self.near.append(self._zero(self.near[-1]))
        self.near = np.stack(self.near)  # by number of zero bytes, byte of the crc, value of that byte
        self.far = [one]  # by power of two
        while len(self.far) < 40:
            self.far.append(self._apply(self.far[-1], self.far[-1]))

    def _zero(self, c: np.ndarray) -> np.ndarray:
        return self.table[c & np.uint32(255)] ^ (c >> np.uint32(8))

    @staticmethod
    def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
        return tables[0][c & np.uint32(255)] ^ tables[1][(c >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(c >> np.uint32(16)) & np.uint32(255)] ^ tables[3][c >> np.uint32(24)]

    def shifted(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The crcs after n zero bytes, without the inversions at either end."""
        m = np.minimum(n, SHORT)
        out = self.near[m, 0, c & np.uint32(255)] ^ self.near[m, 1, (c >> np.uint32(8)) & np.uint32(255)] ^ self.near[m, 2, (c >> np.uint32(16)) & np.uint32(255)] ^ self.near[m, 3, c >> np.uint32(24)]
        rest = n - m
        for k in range(int(rest.max(initial=0)).bit_length()):
            on = np.flatnonzero((rest >> k) & 1)
            out[on] = self._apply(self.far[k], out[on])
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """crc32 of every span."""
        n = ends - starts
        order = np.argsort(-n, kind="stable")
        long = int(np.count_nonzero(n > SHORT))
        out = np.zeros(len(n), np.uint32)
        for i in order[:long].tolist():
            out[i] = zlib.crc32(data[starts[i] : ends[i]])
        order = order[long:]
        state, at = np.full(len(order), NONE), starts[order]
        alive = np.cumsum(np.bincount(n[order], minlength=1)[::-1])[::-1]  # words of at least so many bytes
        for j in range(len(alive) - 1):
            k = int(alive[j + 1])
            s = state[:k]
            state[:k] = self.table[(s ^ data[at[:k] + j]) & np.uint32(255)] ^ (s >> np.uint32(8))
        out[order] = state ^ NONE
        return out

    def append(self, crc: np.ndarray, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """crc32 of each text followed by a space and a word of n bytes with this crc."""
        s = crc ^ NONE
        spaced = self.table[(s ^ np.uint32(0x20)) & np.uint32(255)] ^ (s >> np.uint32(8)) ^ NONE
        return self.shifted(spaced, n) ^ word


class Features:
    """Buckets of the runs of 1 to n words; one per task."""

    def __init__(self, n: int, buckets: int) -> None:
        self.n, self.buckets, self.kernel, self.crc = n, np.uint32(buckets), Kernel(extra_separators=True), Crc()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def of(self, data: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket) of every feature, and each row's number of words. own: only words that start in so many bytes of their row begin features or count."""
        starts, ends, first = self.kernel.words(data, offsets)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        mine = starts < (offsets[:-1] + own)[rows]
        size = ends - starts
        words = self.crc.words(self.lower[data], starts, ends)
        out_rows, out = [rows[mine]], [words[mine] % self.buckets]
        at, run = np.flatnonzero(mine), words[mine]
        for k in range(1, self.n):
            ok = at + k < first[rows[at] + 1]
            at, run = at[ok], run[ok]
            run = self.crc.append(run, words[at + k], size[at + k])
            out_rows.append(rows[at])
            out.append(run % self.buckets)
        return np.concatenate(out_rows), np.concatenate(out), np.bincount(rows[mine], minlength=len(offsets) - 1)


def spans(data: np.ndarray, separator: np.ndarray, limit: int, carry: int) -> Iterator[tuple[int, int, int]]:
    """(start, own end, end) of the chunks of one text: own parts of about limit bytes that end beside a separator, and the next `carry` words."""

    def following(at: int, wanted: bool) -> int:
        """First place from at on with (or without) a separator, or the end."""
        while at < len(data):
            hit = np.flatnonzero(separator[data[at : at + limit]] == wanted)
            if len(hit):
                return at + int(hit[0])
            at += limit
        return len(data)

    at = 0
    while at < len(data):
        end = at + limit
        if end >= len(data):
            yield at, len(data), len(data)
            return
        back = np.flatnonzero(separator[data[at:end]])
        end = at + int(back[-1]) + 1 if len(back) else following(end, True)
        far = end
        for _ in range(carry):
            far = following(following(far, False), True)
        yield at, end, far
        at = end


def chunks(documents: DataFrame, n: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(row, doc_id, own, text): the chunks of every document; row: one number for each document, own: bytes whose words begin the chunk's features."""

    def make():
        separator = Kernel(extra_separators=True).sep
        row, serial = TaskContext.get().partitionId() << 40, [0]

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            data, offsets = buffers(batch["text"])
            parts: list[tuple] = []
            held = 0

            def columns() -> dict:
                return {"row": pa.array([p[0] for p in parts], pa.int64()), "doc_id": pa.array([p[1] for p in parts], pa.int64()), "own": pa.array([p[2] for p in parts], pa.int64()), "text": pa.array([p[3] for p in parts], pa.binary()).cast(pa.string())}

            for i, doc in enumerate(batch["doc_id"].to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                for start, own, end in spans(text, separator, chunk_bytes, n - 1) if len(text) else [(0, 0, 0)]:
                    parts.append((row + serial[0], doc, own - start, text[start:end].tobytes()))
                    held += end - start
                    if held > 1 << 22:
                        yield columns()
                        parts, held = [], 0
                serial[0] += 1
            if parts:
                yield columns()

        return step

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "row long, doc_id long, own long, text string")


def bucket_counts(parts: DataFrame, n: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of (own, text). Each task sends its sums; `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        features, total = Features(n, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            own = batch["own"].to_numpy()
            for lo, hi, data, offsets in slices(batch["text"]):
                total += np.bincount(features.of(data, offsets, own[lo:hi])[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "c": pa.array(total[at])})
        trim()

    out = np.zeros(buckets, np.int64)
    for r in parts.select("own", "text").mapInArrow(run, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[r["bucket"]] = r["c"]
    return out


def gains(target: np.ndarray, source: np.ndarray, scale: int = 1000) -> np.ndarray:
    """By bucket: floor(scale * ln of the target's smoothed share over the source's)."""
    t, s, m = target.astype(float), source.astype(float), float(len(source))
    return np.floor(scale * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def gain_sums(parts: DataFrame, gain: np.ndarray, n: int = 2) -> DataFrame:
    """The columns of parts but text and own, with n_words, n_features and the summed gains of each row's own features."""
    kept = [c for c in parts.columns if c not in ("text", "own")]
    shared = parts.sparkSession.sparkContext.broadcast(gain)

    def make():
        features = Features(n, len(shared.value))

        def step(batch: pa.RecordBatch) -> dict:
            own, words, many, total = batch["own"].to_numpy(), [], [], []
            for lo, hi, data, offsets in slices(batch["text"]):
                rows, bucket, count = features.of(data, offsets, own[lo:hi])
                words.append(count)
                many.append(np.bincount(rows, minlength=hi - lo))
                total.append(np.bincount(rows, shared.value[bucket], hi - lo).astype(np.int64))  # whole numbers far below 2^53
            return {c: batch[c] for c in kept} | {"n_words": pa.array(np.concatenate(words)), "n_features": pa.array(np.concatenate(many)), "gained": pa.array(np.concatenate(total))}

        return step

    return map_batches(parts, make, ", ".join(f"{c} {t}" for c, t in parts.dtypes if c in kept) + ", n_words long, n_features long, gained long")


def scored(documents: DataFrame, target: DataFrame, n: int = 2, buckets: int = BUCKETS, seed: int = 7, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Stored (doc_id, n_words, n_features, weight, score) of every document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text") > chunk_bytes, F.lit(False))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("own")
    short, cut = docs.where(~long).select("doc_id", size, "text"), stored(chunks(docs.where(long), n, chunk_bytes))
    gain = gains(bucket_counts(target.select(size, "text"), n, buckets), bucket_counts(short.select("own", "text").unionByName(cut.select("own", "text")), n, buckets))
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "gained")]
    rows = gain_sums(short, gain, n).unionByName(gain_sums(cut, gain, n).groupBy("row", "doc_id").agg(*sums).drop("row"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    weight = F.when(F.col("n_features") > 0, F.expr("(gained - pmod(gained, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return stored(rows.select("doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score")))


def ranked(rows: DataFrame, percent: int = 25, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the rows with so many words, `percent` of a hundred with the highest scores get ranks from 1, ties by the smaller id; all others null."""
    may = rows.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight").asc(), F.col("n_features").asc()]
    placed = stored(may.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())  # a row for each partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    most = percent * before[-1] // 100
    start = rows.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "part long, start long")
    rank = F.col("start") + (F.col("place").bitwiseAND(F.lit((1 << 33) - 1))) + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = placed.withColumn("part", part.cast("long")).join(F.broadcast(start), "part").select(*columns, F.when(rank <= most, rank).alias("rank"))
    return drawn.unionByName(rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = BUCKETS, seed: int = 7, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; drawn ones have a rank."""
    return ranked(scored(documents, target, n, buckets, seed, chunk_bytes), percent, least_words)


def drawn(documents: DataFrame, resampled: DataFrame) -> DataFrame:
    """The documents, whole, whose id was drawn."""
    return documents.join(resampled.where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")


def _oracle() -> str:
    crc = "list_reduce(list_concat([4294967295::bigint], list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::bigint)), lambda a, b: xor(table_[xor(a & 255, b) + 1], a >> 8))"
    return f"""
with recursive bits(i, k, v) as (select i, 0, i::bigint from range(256) t(i) union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
tab as (select list(v order by i) table_ from bits where k = 8),
src as (select doc_id, coalesce(text, '') text, row_number() over () r, false t from documents union all select null, coalesce(text, ''), -row_number() over (), true from benchmark),
w as (select doc_id, r, t, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') w from src),
f as (select r, t, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from w),
b as materialized (select f, xor({crc}, 4294967295) % 10000 b from (select distinct f from f), tab),
c as materialized (select r, t, b, count(*) c from f join b using (f) group by all),
s as (select b, coalesce(sum(c) filter (t), 0)::double tb, coalesce(sum(c) filter (not t), 0)::double sb, (select coalesce(sum(c), 0) from c where t)::double ta, (select coalesce(sum(c), 0) from c where not t)::double sa from c group by b),
g as materialized (select b, floor(1000 * ln((tb + 1) * (sa + 10000) / ((sb + 1) * (ta + 10000))))::bigint g from s),
d as (select doc_id, len(w) n_words, coalesce(n, 0)::bigint n_features, case when n > 0 then (total - ((total % n) + n) % n) // n else 0 end::bigint weight
  from w left join (select r, sum(c)::bigint n, sum(c * g)::bigint total from c join g using (b) where not t group by r) using (r) where not t),
e as (select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint score from d),
k as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id) end place, count(*) filter (n_words >= 20) over () many from e)
select doc_id, n_features, weight, score, case when place <= 25 * many // 100 then place end::bigint rank from k"""


#: the table and its use are the plain definition of crc32, byte by byte
ORACLE = _oracle()
