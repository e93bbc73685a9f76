"""Near-duplicate groups by b-bit MinHash over five-word shingle sets, exact links, connected components.

1. One pass over the texts: every document's shingle set (64-bit shingle hashes), a 128-bit key of the whole set, 384 minima; of the minima the low 4 bits are packed into 24 longs, and the full minima are hashed into 64 bands of 6 rows.
2. Documents with the same set are one class; only a class's smallest id goes on.
3. Candidates: within a band bucket every class meets one class of the bucket, chosen at random by bucket, so a bucket of n classes gives n - 1 pairs. The packed bits' collision-corrected similarity drops the clearly different ones; the rest are confirmed on the full sets.
4. Components of these links. Buckets that then hold classes of more than one component are finished exactly, without laying out their pairs: between() compares each class with a pivot and lets two classes meet only where what they don't share with the pivot makes a link possible. Classes of one component need no further test, as they are linked already; so no link between different components is lost.

With 64 bands of 6 rows, a pair at similarity 0.75 shares no bucket with probability 4e-6, at 0.8 with 5e-9; the bits drop it with probability 7e-6, at 0.8 with less than 1e-9.
The full sets are computed for documents in candidate pairs only; a bit table of fixed greatest size keeps most other texts from being hashed and shuffled again.
A document without words has the empty set and is linked with nothing. Null texts count as empty. Rows that repeat a doc_id are one node with several sets. Equal sets in any number form one class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import join_counted, map_batches, tidy
from quarry.llm.components import components
from quarry.llm.kernel import Kernel, mix, shingles, slices
from quarry.session import stored

HASHES, BANDS, ROWS, BITS = 384, 64, 6, 4
LONGS = HASHES * BITS // 64
BLOOM_BITS = 27  # of the bit table, at most
THRESHOLD = 75  # per cent
GROUP = 1024  # classes that are compared with a copy of their group's pivot
SLACK = 0.10  # a pair whose estimate is as far under the threshold is not confirmed: over 4 standard deviations at the threshold


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    s = (mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return s[:HASHES] | np.uint32(1), s[HASHES:]


def signature(unique: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1024) -> np.ndarray:
    """The minimum of every hash function over the upper halves of a set's shingle hashes."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (unique >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), block):
        np.minimum(out, (x[None, i : i + block] * a[:, None] + b[:, None]).min(1), out=out)
    return out.astype(np.uint64)


def pack(minima: np.ndarray) -> np.ndarray:
    """The low bits of (mixed) minima, packed into longs."""
    low = mix(minima) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return np.bitwise_or.reduce(low.reshape(LONGS, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1)


def features(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set key (two longs, null for the empty set), packed bits, band keys."""

    def make():
        kernel, (a, b) = Kernel(), _seeds()
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

        def step(batch: pa.RecordBatch) -> dict:
            size, key_a, key_b, sig, bands = [], [], [], [], []
            for lo, hi, data, offsets in slices(batch["text"]):
                sh, at = shingles(*kernel.word_hashes(data, offsets))
                for i in range(hi - lo):
                    u = np.unique(sh[at[i] : at[i + 1]])
                    size.append(len(u))
                    if not len(u):
                        key_a.append(None), key_b.append(None), sig.append(None), bands.append(None)
                        continue
                    minima = signature(u, a, b)
                    band = mix((mix(minima[: BANDS * ROWS]).reshape(-1, ROWS) * np.arange(1, 2 * ROWS, 2, dtype=np.uint64)).sum(1, dtype=np.uint64) + salt)
                    key_a.append(int(mix(u).sum(dtype=np.uint64).astype(np.int64)))
                    key_b.append(int(np.bitwise_xor.reduce(mix(u * np.uint64(0xD6E8FEB86659FD93))).astype(np.int64)))
                    sig.append(pack(minima).astype(np.int64))
                    bands.append(band.astype(np.int64))
            longs = pa.list_(pa.int64())
            return {"doc_id": batch["doc_id"], "n_shingles": pa.array(size, pa.int64()), "set_a": pa.array(key_a, pa.int64()), "set_b": pa.array(key_b, pa.int64()), "sig": pa.array(sig, longs), "bands": pa.array(bands, longs)}

        return step

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>")


def bit_table(ids: DataFrame) -> np.ndarray:
    """Bits at the hashes of the ids, 16 for each id but 2^27 at most: what isn't in the table isn't among the ids."""
    bits = min(BLOOM_BITS, max(10, int(16 * ids.count()).bit_length()))
    at = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)).alias("at"))
    words = at.groupBy(F.expr("cast(at div 64 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("m")).toArrow()  # 2^21 rows at most
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy()] = words["m"].to_numpy()
    return table.view(np.uint64)


def shingle_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, set: the sorted distinct shingle hashes, for all wanted documents and few others."""
    shared = documents.sparkSession.sparkContext.broadcast(bit_table(wanted))

    def make():
        kernel, table = Kernel(), shared.value

        def step(batch: pa.RecordBatch) -> dict | None:
            at = batch["at"].to_numpy() % (64 * len(table))
            batch = batch.filter(pa.array(((table[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)))
            out = []
            for lo, hi, data, offsets in slices(batch["text"]):
                sh, at = shingles(*kernel.word_hashes(data, offsets))
                out += [np.unique(sh[at[i] : at[i + 1]]).astype(np.int64) for i in range(hi - lo)]
            return {"doc_id": batch["doc_id"], "set": pa.array(out, pa.list_(pa.int64()))} if out else None

        return step

    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return map_batches(keyed.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << BLOOM_BITS))), make, "doc_id long, set array<long>")


def estimate(left: str, right: str) -> Column:
    """Collision-corrected similarity of two packed signatures: matches of random low bits are taken off."""
    ones = 0x1111111111111111
    differing = F.expr(f"aggregate(zip_with({left}, {right}, (x, y) -> bit_count(((x ^ y) | shiftrightunsigned(x ^ y, 1) | shiftrightunsigned(x ^ y, 2) | shiftrightunsigned(x ^ y, 3)) & {ones}L)), 0, (s, x) -> s + x)")
    by_chance = 1.0 / (1 << BITS)
    return ((1 - differing / HASHES) - by_chance) / (1 - by_chance)


def near_enough(na: str, nb: str, sa: str, sb: str) -> Column:
    """False only for pairs of sets whose sizes or packed bits rule the threshold out."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * THRESHOLD) & (estimate(sa, sb) >= THRESHOLD / 100 - SLACK)


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and packed bits don't rule out."""
    return (
        pairs.join(nodes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
        .join(nodes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
        .where(near_enough("na", "nb", "sa", "sb"))
        .select("a", "b")
    )


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. sets: doc_id, set."""
    shared = (
        pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
        .join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
        .withColumn("common", F.size(F.array_intersect("x", "y")))
    )
    return shared.where(F.col("common") * 100 >= (F.size("x") + F.size("y") - F.col("common")) * THRESHOLD).select("a", "b").distinct()


def groups(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    key = ["set_a", "set_b", "n_shingles"]
    feats = stored(features(documents))
    filled = feats.where("n_shingles > 0")
    classes = stored(filled.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    same = stored(join_counted(filled.select("doc_id", *key), classes, key, "size").select("doc_id", "rep"))
    # a doc_id with several rows may stand for several sets: rep + set key names a class
    nodes = stored(filled.join(classes.select(*key, F.col("rep").alias("doc_id")), ["doc_id", *key]).dropDuplicates(["doc_id", "set_a", "set_b"]).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig", "bands"))
    members = stored(nodes.select(F.col("rep").alias("d"), F.explode(F.array_distinct("bands")).alias("key")))
    buckets = stored(members.groupBy("key").agg(F.expr("min(struct(xxhash64(d, key) as h, d as d)).d").alias("lead"), F.count("*").alias("size")).where("size > 1"))
    crowded = stored(join_counted(members, buckets, ["key"], "size"))
    star = crowded.where("d <> lead").select(F.least("lead", "d").alias("a"), F.greatest("lead", "d").alias("b")).distinct()
    near_pairs = stored(near(star, nodes))
    links = stored(linked(near_pairs, shingle_sets(documents, ends(near_pairs))))
    first = stored(components(links))
    tidy(documents.sparkSession)
    rest = stored(between(crowded, first, nodes, documents))
    tidy(documents.sparkSession)
    several = feats.groupBy("doc_id").count().where("count > 1")
    repeated = same.where("doc_id <> rep").join(several, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))  # one id, several sets
    final = components(links.union(rest).union(repeated))
    label = (
        same.join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", F.coalesce("component", "rep").alias("c")).groupBy("doc_id").agg(F.min("c").alias("c"))
    )
    out = feats.select("doc_id", "n_shingles").join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def ends(pairs: DataFrame) -> DataFrame:
    """(doc_id) of both ends, stored."""
    return stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())


def mixed(placed: DataFrame) -> DataFrame:
    """The rows (key, d, lead, c) of buckets that hold several components, with each bucket's largest (big)."""
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    largest = parts.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("big"), F.count("*").alias("parts"), F.sum("n").alias("size")).where("parts > 1")
    return join_counted(placed, largest, ["key"], "size").select("key", "d", "lead", "c", "big")


def between(crowded: DataFrame, first: DataFrame, nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) between classes of one bucket and different components, beyond those with the bucket's lead.

    Buckets with the same largest component g are one group; its pivot is the class of g that stands in most of these buckets, the set P. Of every class x of a group, a = |x and P| and the rest E = x without P are counted exactly. Linked means 7 |x and y| >= 3 (|x| + |y|), and |x and y| is at most min(a(x), a(y)) + |E(x) and E(y)|. So of two classes
    - both linked with P are in one component by that;
    - otherwise they have t = ceil((3 (|x| + |y|) - 7 a(x)) / 7) elements of E in common. Where t is positive, they meet in a join on elements of E, to which each class brings all but its t - 1 most frequent ones (those that nobody shares are the rarest, and need not go);
    - where t isn't positive, y is so much smaller that 3 |y| <= 7 a(x) - 3 |x|, and they meet in a join on sizes.
    Classes that differ from the pivot in elements of their own thus meet nobody, and no pairs are made within a group of copies.
    """
    placed = crowded.where("size > 2").join(first.withColumnRenamed("node", "d"), "d", "left").select("key", "d", "lead", F.coalesce("component", "d").alias("c"))
    attached = stored(mixed(placed).groupBy(F.col("big").alias("g"), "d", "c").agg(F.count("*").alias("times")))
    wanted = stored(attached.select(F.col("d").alias("doc_id")).distinct())
    sets = stored(shingle_sets(documents, wanted).join(wanted, "doc_id", "left_semi"))
    sized = attached.join(sets.groupBy(F.col("doc_id").alias("d")).agg(F.min(F.size("set")).alias("n")), "d")
    tidy(documents.sparkSession)
    of = stored(sized.groupBy("g").agg(F.max_by("d", F.when(F.col("c") == F.col("g"), F.struct("times", -F.col("n"), -F.col("d")))).alias("p"), F.min("n").alias("least"), F.count("*").alias("size")))
    # a group's pivot set is laid out once for every GROUP of its classes, so that a large group fills many tasks
    parts = F.ceil(F.col("size") / GROUP).cast("int")
    pivots = of.join(sets.select(F.col("doc_id").alias("p"), F.col("set").alias("pivot")), "p").dropDuplicates(["g"]).select("g", "p", "least", "pivot", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = join_counted(attached, of.select("g", "size"), ["g"], "size").select("g", "d", "c", F.pmod(F.xxhash64("d"), parts).cast("int").alias("part"))
    rows = dealt.join(sets.select(F.col("doc_id").alias("d"), "set"), "d").join(pivots, ["g", "part"])
    rows = rows.select("g", "d", "c", "p", "least", F.size("pivot").alias("np"), F.size("set").alias("n"), F.array_except("set", "pivot").alias("own")).withColumn("a", F.col("n") - F.size("own"))
    rows = rows.withColumn("low", F.greatest("least", F.ceil(F.col("n") * THRESHOLD / 100)).cast("int")).withColumn("near", F.expr("7 * a >= 3 * (n + np)")).withColumn("t", F.expr("cast(ceil((3 * (n + low) - 7 * a) / 7) as int)"))
    rows = stored(rows.drop("np"))
    direct = rows.where("near and c <> g and d <> p").select(F.least("p", "d").alias("a"), F.greatest("p", "d").alias("b"))
    # elements of E that two classes share, and those of each class that it brings
    single = rows.select("g", "d", "c", F.monotonically_increasing_id().alias("row"), F.expr("size(own) - greatest(t, 1) + 1").alias("k"), F.size("own").alias("of"), F.explode("own").alias("e"))
    single = stored(single.where("k > 0"))
    often = stored(single.groupBy("g", "e").agg(F.count("*").alias("df"), F.count_if(F.col("c") != F.col("g")).alias("out")).where("df > 1 and out > 0"))
    shared = join_counted(single, often.select("g", "e", "df"), ["g", "e"], "df")
    brings = shared.groupBy("g", "d", "c", "row", "k", "of").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s"))
    brings = stored(brings.select("g", "d", "c", F.explode(F.expr("slice(s, 1, greatest(0, k - (of - size(s))))")).alias("s")).select("g", "d", "c", "s.e"))
    y = brings.select("g", "e", F.col("d").alias("y"), F.col("c").alias("cy"))
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    by_element = brings.where("c <> g").select("g", "e", F.col("d").alias("x"), F.col("c").alias("cx")).join(y, ["g", "e"]).where("cx <> cy and (cy = g or x < y)").select(*pair)
    small = rows.where("not near").withColumn("high", F.expr("least(cast(floor((7 * a - 3 * n) / 3) as int), n * 4 div 3)")).where("high >= low").select("g", F.col("d").alias("x"), F.col("c").alias("cx"), F.col("n").alias("nx"), F.explode(F.sequence("low", "high")).alias("n"))
    by_size = small.join(rows.select("g", "n", F.col("d").alias("y"), F.col("c").alias("cy"), F.col("a").alias("ay")), ["g", "n"]).where("cx <> cy and 7 * ay - 3 * n >= 3 * nx").select(*pair)
    return direct.union(linked(stored(near(by_element.union(by_size).distinct(), nodes)), sets)).distinct()


def dedup(documents: DataFrame) -> DataFrame:
    """The rows, whole, of one document of each group: that of the smallest id."""
    gone = groups(documents).where("not kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti").select(documents.columns)


ORACLE = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as l from documents),
s as (select distinct doc_id, unnest(case when len(l) = 0 then [] when len(l) < 5 then [array_to_string(l, ' ')] else list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
r(d, x) as (select doc_id, doc_id from documents union select r.d, e.b from r join e on e.a = r.x),
k as (select d, min(x) as component_id from r group by d)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, k.component_id, w.doc_id = k.component_id as kept from w left join n using (doc_id) join k on k.d = w.doc_id
"""
