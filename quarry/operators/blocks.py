"""Exact top-k retrieval for a table of queries, reading only the blocks that can hold a result.

Rows are dealt to blocks of bounded size in an order that the caller names (rows that share words should be neighbours). A term's postings in a block are one stored row; another table has the greatest weight of each field in it. A query's bound in a block is the sum of its terms' greatest scores there, and no row of the block scores more.

A search takes three passes. The first scores, for each query, the blocks of greatest bound, and finds the k-th best score so far; the second does the same with more blocks. The third scores what is left with a bound of that score at least. Rows of all other blocks score less than k rows do that are known already, so the result is that of scoring everything. A pass scores whole blocks of many queries in one job, a block in one place: what is shuffled are the packed postings of the chosen blocks, and of the rows those that reach the score found before.

Vectors go the same way: a block is a run of vectors near one pivot, with a centre and a radius, and no vector v of it has a product with q above q.centre + |q| radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.text import DIGITS, tokens
from quarry.operators.index import TextIndex
from quarry.session import stored

SLACK = 1e-9  # vectors: bounds and products round differently
MORE = 8  # how many times more blocks the second pass reads
UNIT = 10**9  # text scores are added in whole billionths, so that sums don't depend on their order


def numbered(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with `block`, runs of up to `size` rows in this order, and `place`, a row's number in its block. One range shuffle; stored, so that numbers stay as they are."""
    return stored(in_order(rows, order).withColumns({"block": F.expr(f"at div {size}"), "place": F.expr(f"cast(at % {size} as int)")}).drop("at"))


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of this order, numbered by `at`: from one row of a range to the next by one."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())


def leading(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each `by`: tasks keep n of each before they meet."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def kth(scores: DataFrame, by: str, score: str, k: int) -> DataFrame:
    """(by, least): the k-th greatest score of each `by`; those with fewer have no row."""
    ranked = scores.select(by, F.col(score).alias("least")).withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("least"))))
    return ranked.where(F.col("__n") <= k).where(F.col("__n") == k).select(by, "least")


LISTS = "places array<smallint>, fs array<tinyint>, tfs array<int>, dls array<int>"


def lists(words: pa.DictionaryArray, code: np.ndarray, block: np.ndarray, place: np.ndarray, f: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> Iterator[dict]:
    """Postings as a row for each term and block, with its LISTS by place and field. They come sorted by code, block, place and field."""
    start = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(block) != 0)))
    ends = np.append(start, len(code))
    for lo in range(0, len(start), 1 << 16):
        hi = min(len(start), lo + (1 << 16))
        own = slice(ends[lo], ends[hi])
        cut = pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32))
        made = {n: pa.ListArray.from_arrays(cut, pa.array(x[own].astype(t))) for n, x, t in (("places", place, np.int16), ("fs", f, np.int8), ("tfs", tf, np.int32), ("dls", dl, np.int32))}
        yield {"term": words.take(pa.array(code[start[lo:hi]])), "block": pa.array(block[start[lo:hi]])} | made


@dataclass
class BlockIndex:
    """impacts(term, block, LISTS): a term's postings in a block, by the rows' places; bests(term, block, n, counts, tops): how many rows and postings of each field those are, and the greatest weight of each field without its idf; both sorted by (term, block) within files. rows(id, block, place, ...): every row's block and the columns that filters and keys need. fields: (name, boost, mean length); idfs: of a table of terms, (term, idfs) by field."""

    impacts: DataFrame
    bests: DataFrame
    rows: DataFrame
    fields: list[tuple[str, float, float]]
    idfs: Callable[[DataFrame], DataFrame]
    k1: float = rules.K1
    b: float = rules.B

    @staticmethod
    def build(index: TextIndex, rows: DataFrame, order: list[str], boosts: dict[str, float] | None = None, size: int = 256, k1: float = rules.K1, b: float = rules.B) -> BlockIndex:
        """From an index that there is. rows: id and the columns to keep. Scores are those of TextIndex.search() with these boosts, all fields of a term summed."""
        dealt = numbered(rows, order, size)
        boosts = boosts or rules.FIELD_BOOSTS
        fields = [(r["field"], boosts[r["field"]], r["avgdl"]) for r in index.fields.collect() if r["field"] in boosts]  # a row for each field
        number = F.coalesce(*[F.when(F.col("field") == f[0], i) for i, f in enumerate(fields)], F.lit(None).cast("int"))
        own = index.postings.select(F.col("id").cast("long").alias("id"), "term", number.alias("f"), F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl")).where("f is not null").join(dealt.select("id", "block", "place"), "id")

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            """Of a block, one row for each term."""
            words = rows["term"].combine_chunks().dictionary_encode()
            code = words.indices.to_numpy()
            at = np.lexsort((rows["f"].to_numpy(), rows["place"].to_numpy(), code))
            return pa.concat_tables([pa.table(x) for x in lists(words.dictionary, code[at], np.full(len(at), key[0].as_py()), *(rows[c].to_numpy()[at] for c in ("place", "f", "tf", "dl")))])

        packed = own.groupBy("block").applyInArrow(pack, f"term string, block long, {LISTS}")
        impacts = stored(packed.sortWithinPartitions("term", "block"))
        given = F.array(*[F.max(F.when(F.col("field") == f[0], F.col("idf"))) for f in fields]).cast("array<double>")
        return BlockIndex(impacts, best_of(impacts, fields, k1, b), dealt, fields, lambda terms: index.terms.join(terms, "term", "left_semi").groupBy("term").agg(given.alias("idfs")), k1, b)

    @staticmethod
    def of(rows: DataFrame, id_: str, texts: dict[str, Column], keep: dict[str, Column], order: list[str], boosts: dict[str, float] | None = None, size: int = 256, k1: float = rules.K1, b: float = rules.B) -> BlockIndex:
        """From the rows themselves, each with an id of its own. Only rows are shuffled, once, into their order, and each block's postings are packed where its rows then lie; texts and keep are made after the shuffle, so that it has no text twice. All statistics come from what is packed."""
        boosts = boosts or rules.FIELD_BOOSTS
        names = [f for f in texts if f in boosts]
        dealt = in_order(rows, order).select("at", F.col(id_).cast("long").alias("id"), *[c.alias(n) for n, c in keep.items()], *[tokens(texts[f]).alias(f"__{f}") for f in names])
        kept = [f"{n} {t}" for n, t in dealt.dtypes if n == "id" or n in keep]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each row, without a term, and a row for each term of each block. A block may lie in two batches: its rows wait for their last."""
            waiting: list[pa.RecordBatch] = []
            for x in batches:
                if x.num_rows:
                    at = x["at"].to_numpy() // size
                    last = int(np.searchsorted(at, at[-1]))
                    if waiting and (last or waiting[0]["at"][0].as_py() // size != at[-1]):
                        yield from packed(pa.concat_batches([*waiting, x.slice(0, last)]))
                        waiting = []
                    elif last:
                        yield from packed(x.slice(0, last))
                    waiting.append(x.slice(last))
            if waiting:
                yield from packed(pa.concat_batches(waiting))

        def packed(x: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = x["at"].to_numpy()
            block, nth = np.unique(at // size, return_inverse=True)
            words = [x[f"__{f}"].flatten() for f in names]
            long = [x[f"__{f}"].value_lengths().fill_null(0).to_numpy() for f in names]
            none = [pa.nulls(x.num_rows, t) for t in (pa.string(), *LIST_TYPES)]
            lens = pa.ListArray.from_arrays(pa.array((np.arange(x.num_rows + 1) * len(names)).astype(np.int32)), pa.array(np.stack(long, axis=1).astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([none[0], pa.array(at // size), *none[1:], pa.array((at % size).astype(np.int32)), lens, *[x[n.split(" ")[0]] for n in kept]], names=columns)
            every = pa.concat_arrays(words).dictionary_encode()
            if not len(every):
                return
            row = np.concatenate([np.repeat(np.arange(x.num_rows), n) for n in long])
            f = np.repeat(np.arange(len(names)), [len(w) for w in words])
            key, tf = np.unique(((every.indices.to_numpy().astype(np.int64) * len(block) + nth[row]) * size + at[row] % size) * len(names) + f, return_counts=True)
            key, f = np.divmod(key, len(names))
            key, place = np.divmod(key, size)
            code, own = np.divmod(key, len(block))
            start = np.searchsorted(nth, np.arange(len(block)))  # a block's rows are neighbours
            dl = np.stack(long, axis=1)[start[own] + place - at[start[own]] % size, f]
            for part in lists(every.dictionary, code, block[own], place, f, tf, dl):
                size_ = len(part["block"])
                yield pa.RecordBatch.from_arrays([*part.values(), *[pa.nulls(size_, t) for t in (pa.int32(), pa.list_(pa.int32()), *(x[n.split(" ")[0]].type for n in kept))]], names=columns)

        schema = f"term string, block long, {LISTS}, place int, lens array<int>, {', '.join(kept)}"
        columns = ["term", "block", "places", "fs", "tfs", "dls", "place", "lens", *[n.split(" ")[0] for n in kept]]
        all_ = stored(dealt.mapInArrow(pack, schema).sortWithinPartitions("term", "block"))
        impacts, rows = all_.where("term is not null").select(*columns[:6]), all_.where("term is null").select("id", "block", *columns[6:7], *[n for n in keep if n != "id"], "lens")
        n, *total = rows.agg(F.count("*"), *[F.coalesce(F.sum(F.col("lens")[i]), F.lit(0)) for i in range(len(names))]).first()
        fields = [(f, boosts[f], t / max(n, 1)) for f, t in zip(names, total)]
        bests = best_of(impacts, fields, k1, b)
        counted = lambda terms: terms.groupBy("term").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(len(names))])
        raw = [F.when(F.col(f"c{i}") > 0, F.log(n - F.col(f"c{i}") + 0.5) - F.log(F.col(f"c{i}") + 0.5)) for i in range(len(names))]
        means = counted(bests).agg(*[F.avg(r) for r in raw]).first()
        floors = [None if m is None else rules.EPSILON * m for m in means]
        found = F.array(*[F.when(r < 0, F.lit(m).cast("double")).otherwise(r) for r, m in zip(raw, floors)])
        return BlockIndex(impacts, bests, rows.drop("lens"), fields, lambda terms: counted(bests.join(terms, "term", "left_semi")).select("term", found.alias("idfs")), k1, b)

    def weighed(self, terms: DataFrame) -> DataFrame:
        """Stored terms (qid, term, qtf) with `idfs` by field; those that no row has are left out."""
        return stored(terms.join(self.idfs(terms.select("term").distinct()), "term"))

    def bounds(self, terms: DataFrame) -> DataFrame:
        """(qid, block, bound, n): every block with a term of the query, and a score in whole billionths that none of its rows exceeds. terms: qid, term, qtf (and idfs)."""
        terms = terms if "idfs" in terms.columns else self.weighed(terms)
        hit = self.bests.select("term", "block", "tops", "n").join(terms, "term")
        parts = [F.greatest(F.coalesce(F.col("idfs")[i] * f[1], F.lit(0.0)), F.lit(0.0)) * F.col("tops")[i] for i, f in enumerate(self.fields)]
        most = F.ceil(sum(parts, F.lit(0.0)) * (UNIT * (1 + SLACK))) + 1
        return hit.groupBy("qid", "block").agg(F.sum(F.col("qtf") * most).alias("bound"), F.max("n").alias("n"))

    def scored(self, terms: DataFrame, blocks: DataFrame, least: DataFrame | None = None) -> DataFrame:
        """(qid, id, bm25_score) of all rows of these blocks (qid, block) that score above 0; of the named rows only, if blocks has `place`; with `least` (qid, least), of those that score so much at least."""
        return self.found(terms, blocks, least).select("qid", "id", "bm25_score")

    def found(self, terms: DataFrame, blocks: DataFrame, least: DataFrame | None = None) -> DataFrame:
        """The rows of scored() with the columns of rows."""
        terms = terms if "idfs" in terms.columns else self.weighed(terms)
        kind = terms.schema["qid"].dataType.simpleString()
        named = "place" in blocks.columns
        wants = blocks.groupBy("qid", "block").agg(F.collect_list("place").alias("only")) if named else blocks.select("qid", "block")  # a block's rows at most
        wants = wants.join(terms.groupBy("qid").agg(F.collect_list("term").alias("terms"), F.collect_list("qtf").alias("times")), "qid")  # a query's terms
        wants = wants.withColumn("least", F.lit(0.0)) if least is None else wants.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        some = blocks.select("block").distinct()
        chosen = self.impacts.join(terms.select("term", "idfs").dropDuplicates(["term"]), "term").join(some, "block", "left_semi")
        wants = wants.withColumn("at", F.col("block") + 0)  # both sides may come from one table
        fields, k1, b = self.fields, self.k1, self.b

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The lists' scores in whole billionths, all fields of a row summed."""
            boost = np.array([f[1] for f in fields], float)
            for x in batches:
                if not x.num_rows:
                    continue
                row, place, f, w = weights(x, fields, k1, b)
                part = boost[f] * np.nan_to_num(x["idfs"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(x.num_rows, -1))[row, f] * w
                start = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(place) != 0)))
                total = np.add.reduceat(part, start) * UNIT
                total = np.trunc(total + np.copysign(0.5, total)).astype(np.int64)
                first = np.flatnonzero(np.append(True, np.diff(row[start]) != 0))
                cut = pa.array(np.append(first, len(start)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({"at": x["block"], "term": x["term"], "ids": pa.ListArray.from_arrays(cut, pa.array(place[start])), "scores": pa.ListArray.from_arrays(cut, pa.array(total))})

        chosen = chosen.select("block", "term", "idfs", "places", "fs", "tfs", "dls").mapInArrow(score, "at long, term string, ids array<smallint>, scores array<long>")

        def run(chosen: pa.Table, wants: pa.Table) -> pa.Table:
            out_at, out_id, out_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int16)], [np.zeros(0, np.int64)]
            if chosen.num_rows and wants.num_rows:
                place = {t: i for i, t in enumerate(chosen["term"].to_pylist())}
                ids, where = np.unique(flatten(chosen["ids"]), return_inverse=True)
                own = np.zeros((len(place), len(ids)))
                own[np.repeat(np.arange(len(place)), lengths(chosen["ids"])), where] = flatten(chosen["scores"])
                enough = np.rint(wants["least"].to_numpy() * UNIT)
                for lo in range(0, wants.num_rows, 256):  # whole numbers below 2^53: exact in doubles
                    part = wants.slice(lo, 256)
                    row = np.repeat(np.arange(part.num_rows), lengths(part["terms"]))
                    code = np.array([place.get(t, -1) for t in flatten(part["terms"])], np.int64)
                    asks = np.zeros((part.num_rows, len(place)))
                    np.add.at(asks, (row[code >= 0], code[code >= 0]), flatten(part["times"])[code >= 0])
                    s = asks @ own
                    keep = (s > 0) & (s >= enough[lo : lo + 256, None])
                    if named:
                        for i, only in enumerate(part["only"].to_pylist()):
                            keep[i] &= np.isin(ids, only)
                    i, j = np.nonzero(keep)
                    out_at.append(lo + i)
                    out_id.append(ids[j])
                    out_s.append(s[i, j].astype(np.int64))
            return pa.table({"qid": wants["qid"].take(pa.array(np.concatenate(out_at))), "at": wants["at"].take(pa.array(np.concatenate(out_at))), "place": pa.array(np.concatenate(out_id).astype(np.int32)), "s": pa.array(np.concatenate(out_s))})

        hits = chosen.groupBy("at").cogroup(wants.groupBy("at")).applyInArrow(run, f"qid {kind}, at long, place int, s long")
        hits = hits.select("qid", F.col("at").alias("block"), "place", (F.col("s") / UNIT).alias("bm25_score"))
        return hits.join(self.rows.join(some, "block", "left_semi"), ["block", "place"])

    def search(self, terms: DataFrame, k: int, key: str = "id", allowed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """Stored (qid, id, the columns of rows, bm25_score) of at least the best row of each of the k best keys of the query; and stored (qid, blocks, read), how many blocks have a term of the query and how many were read.

        terms: qid, term, qtf, a stored table. allowed: keeps of rows with qid the ones that a query admits, before the cut.
        """
        terms = self.weighed(terms)
        bounds = stored(self.bounds(terms))
        few = 2 + 2 * k // max(1, self._usual(bounds))
        hits, seen, least = None, None, None
        for most in (few, few * MORE, None):
            left = bounds
            if seen is not None:
                left = left.join(least, "qid", "left").where(F.coalesce(F.col("bound") >= F.round(F.col("least") * UNIT).cast("long"), F.lit(True))).join(seen, ["qid", "block"], "left_anti")
            now = stored((left if most is None else leading(left, "qid", [F.desc("bound"), F.col("block")], most)).select("qid", "block"))
            got = self.found(terms, now, least)
            got = stored(got if allowed is None else allowed(got))
            hits = got if hits is None else hits.unionByName(got)
            seen = now if seen is None else seen.unionByName(now)
            if most is not None:
                # by hashes of keys: two keys that meet in one make the k-th score smaller, which loses nothing
                least = stored(kth(hits.groupBy("qid", F.xxhash64(key).alias("h")).agg(F.max("bm25_score").alias("s")), "qid", "s", k))
                hits = hits.join(least, "qid", "left").where(F.coalesce(F.col("bm25_score") >= F.col("least"), F.lit(True))).drop("least")
        read = seen.groupBy("qid").agg(F.count("*").alias("read"))
        return hits, stored(bounds.groupBy("qid").agg(F.count("*").alias("blocks")).join(read, "qid"))

    @staticmethod
    def _usual(bounds: DataFrame) -> int:
        """How many rows of a block hold a term, on average."""
        return int(bounds.agg(F.avg("n")).first()[0] or 1)


#: Arrow's types of LISTS
LIST_TYPES = (pa.list_(pa.int16()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32()))


def weights(x: pa.RecordBatch, fields: list[tuple[str, float, float]], k1: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, place, field, weight without boost and idf) of all postings in its lists."""
    mean = np.array([f[2] for f in fields], float)
    row = np.repeat(np.arange(x.num_rows), x["places"].value_lengths().to_numpy())
    place, f, tf, dl = (x[c].flatten().to_numpy() for c in ("places", "fs", "tfs", "dls"))
    return row, place, f, tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean[f]))


def best_of(impacts: DataFrame, fields: list[tuple[str, float, float]], k1: float, b: float) -> DataFrame:
    """Stored BlockIndex.bests of these lists, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            row, place, f, w = weights(x, fields, k1, b)
            tops, counts = np.zeros((x.num_rows, len(fields))), np.zeros((x.num_rows, len(fields)), np.int32)
            np.maximum.at(tops, (row, f), w)
            np.add.at(counts, (row, f), 1)
            n = np.bincount(row[np.append(True, (np.diff(row) != 0) | (np.diff(place) != 0))], minlength=x.num_rows)
            cut = pa.array((np.arange(x.num_rows + 1) * len(fields)).astype(np.int32))
            up = np.where(tops > 0, np.nextafter(tops.astype(np.float32), np.float32(np.inf)), 0).astype(np.float32)  # no less than what it stands for
            yield pa.RecordBatch.from_pydict({"term": x["term"], "block": x["block"], "n": pa.array(n.astype(np.int32)), "counts": pa.ListArray.from_arrays(cut, pa.array(counts.ravel())), "tops": pa.ListArray.from_arrays(cut, pa.array(up.ravel()))})

    return stored(impacts.mapInArrow(run, "term string, block long, n int, counts array<int>, tops array<float>"))


def flatten(column: pa.ChunkedArray) -> np.ndarray:
    """Values of a column of arrays, one after the other."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def lengths(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().value_lengths().to_numpy()


def flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of arrays of one length, from its flat buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


@dataclass
class VectorBlocks:
    """rows(block, id, v, attributes), sorted by block; centres(block, pack, centre, radius, n), packs being groups of a few thousand blocks. Attributes are numbers that queries may restrict to ranges."""

    rows: DataFrame
    centres: DataFrame
    packs: int
    attributes: tuple[str, ...]

    @staticmethod
    def build(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", attributes: tuple[str, ...] = (), pivots: int = 64, sample: int = 4096, size: int = 256) -> VectorBlocks:
        """Vectors are dealt to the nearest of `pivots` vectors, which are far from each other in a bounded sample (by a hash of the id), and cut into runs of `size` by distance from it. Rows without a vector are left out; all others have one length."""
        rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *[F.col(a).cast("double").alias(a) for a in attributes])
        got = rows.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(sample).collect()  # the bounded sample
        points = np.array([r["v"] for r in got], dtype=np.float64).reshape(len(got), -1)
        chosen = [0] if len(points) else []
        far = ((points - points[0]) ** 2).sum(axis=1) if len(points) else np.zeros(0)
        while len(chosen) < min(pivots, len(points)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        shared = vectors.sparkSession.sparkContext.broadcast(points[chosen])
        schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = np.stack([((flat(b.column("v")) - p) ** 2).sum(axis=1) for p in shared.value], axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1))], names=[*b.schema.names, "cell", "away"])

        placed = numbered(rows.mapInArrow(dealt, f"{schema}, cell int, away double"), ["cell", "away", "id"], size)

        def middle(key: tuple, rows: pa.Table) -> pa.Table:
            v = flat(rows["v"])
            centre = v.mean(axis=0)
            radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1).max())) * (1 + SLACK) + SLACK
            return pa.table({"block": pa.array([key[0].as_py()]), "centre": pa.array([centre.tolist()]), "radius": pa.array([radius]), "n": pa.array([len(v)], pa.int32())})

        centres = stored(placed.select("block", "v").groupBy("block").applyInArrow(middle, "block long, centre array<double>, radius double, n int"))
        packs = 1 + centres.count() // 4096
        return VectorBlocks(placed.drop("cell", "away", "place"), centres.withColumn("pack", F.pmod(F.xxhash64("block"), F.lit(packs)).cast("int")), packs, attributes)

    def bounds(self, queries: DataFrame, least: DataFrame | None = None) -> DataFrame:
        """(qid, block, bound, n) of all blocks, or of those whose bound reaches the query's `least`."""
        kind = queries.schema["qid"].dataType.simpleString()
        asked = queries.select("qid", "q", F.lit(0.0).alias("least")) if least is None else queries.select("qid", "q").join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        asked = asked.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(self.packs - 1))))

        def run(centres: pa.Table, asked: pa.Table) -> pa.Table:
            if not (centres.num_rows and asked.num_rows):
                return pa.table({"qid": asked["qid"].slice(0, 0), "block": pa.array([], pa.int64()), "bound": pa.array([], pa.float64()), "n": pa.array([], pa.int32())})
            q = flat(asked["q"])
            bound = np.clip(q @ flat(centres["centre"]).T + np.sqrt((q**2).sum(axis=1))[:, None] * centres["radius"].to_numpy(), 0, 1)
            i, j = np.nonzero(bound >= asked["least"].to_numpy()[:, None] - SLACK)
            return pa.table({"qid": asked["qid"].take(pa.array(i)), "block": centres["block"].take(pa.array(j)), "bound": pa.array(bound[i, j]), "n": centres["n"].take(pa.array(j))})

        return self.centres.groupBy("pack").cogroup(asked.groupBy("pack")).applyInArrow(run, f"qid {kind}, block long, bound double, n int")

    def scored(self, queries: DataFrame, blocks: DataFrame, k: int, least: DataFrame | None = None) -> DataFrame:
        """(qid, id, semantic_score): of each block (qid, block) the k most similar vectors that the query admits; with `least` (qid, least), of those that score so much at least. queries may have <attribute>_min and <attribute>_max; null is no limit, and a vector without the attribute passes no limit."""
        kind = queries.schema["qid"].dataType.simpleString()
        ends = [f"{a}_{e}" for a in self.attributes for e in ("min", "max") if f"{a}_{e}" in queries.columns]
        wants = blocks.select("qid", "block").join(queries.select("qid", "q", *[F.col(e).cast("double").alias(e) for e in ends]), "qid")
        wants = wants.withColumn("least", F.lit(0.0)) if least is None else wants.join(least, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        rows = self.rows.join(blocks.select("block").distinct(), "block", "left_semi")

        def run(rows: pa.Table, wants: pa.Table) -> pa.Table:
            ids, at, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if rows.num_rows and wants.num_rows:
                s = np.clip(flat(wants["q"]) @ flat(rows["v"]).T, 0, 1).round(DIGITS)
                own = rows["id"].to_numpy()
                fits = s >= wants["least"].to_numpy()[:, None]
                for e in ends:
                    limit, x = wants[e].to_numpy()[:, None], rows[e.rpartition("_")[0]].to_numpy()
                    fits &= np.isnan(limit) | (x >= limit if e.endswith("_min") else x <= limit)
                for i in range(len(s)):
                    may = np.flatnonzero(fits[i])
                    best = may[np.lexsort((own[may], -s[i, may]))[:k]]
                    ids.append(own[best])
                    at.append(np.full(len(best), i))
                    scores.append(s[i, best])
            return pa.table({"qid": wants["qid"].take(pa.array(np.concatenate(at))), "id": pa.array(np.concatenate(ids)), "semantic_score": pa.array(np.concatenate(scores))})

        return rows.groupBy("block").cogroup(wants.groupBy("block")).applyInArrow(run, f"qid {kind}, id long, semantic_score double")

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(qid, id, semantic_score, semantic_rank) of the k most similar vectors of each query, ties by id; and (qid, read, blocks): how many blocks were read of how many. queries: qid, q, limits; a stored table."""
        few = 2 + 2 * k // max(1, self._usual())
        found, first, least = None, None, None
        for most in (few, few * MORE, None):
            left = self.bounds(queries, least)
            left = left if first is None else left.join(first, ["qid", "block"], "left_anti")
            now = stored((left if most is None else leading(left, "qid", [F.desc("bound"), F.col("block")], most)).select("qid", "block"))
            got = stored(self.scored(queries, now, k, least))
            found = got if found is None else found.unionByName(got)
            first = now if first is None else first.unionByName(now)
            if most is not None:
                least = stored(kth(found, "qid", "semantic_score", k))
        w = Window.partitionBy("qid").orderBy(F.desc("semantic_score"), "id")
        ranked = found.withColumn("semantic_rank", F.row_number().over(w) - 1).where(F.col("semantic_rank") < k)
        read = first.groupBy("qid").agg(F.count("*").alias("read"))
        return ranked, read.join(self.centres.agg(F.count("*").alias("blocks")), F.lit(True))

    def _usual(self) -> int:
        return int(self.centres.agg(F.avg("n")).first()[0] or 1)
