"""Ball k-means over whole-number vectors: clusters are balls, and a member meets only the centroids that its place in the ball leaves open.

A cluster's ball has its centroid as centre and its farthest member as radius. After the centroids have moved, the old radius plus the centre's way bounds the new one. Another centroid is a neighbour if it is no farther than twice the radius; only neighbours can take members over. Ordered by distance, half the neighbours' distances cut the ball into a core and annuli: a member in the core stays without a comparison, one in the m-th annulus is compared exactly with the m nearest neighbours. The bounds are strict, so ties are compared, and the result is that of comparing everything with everything.

Components are floor(scale * x); all distances are exact whole numbers (float products below 2^53, else 64-bit integers). Each round is one pass in tasks that hold k centroids, and one grouped sum with a row for each cluster; k rows of sums reach the driver. The vectors with their clusters are written to the shared scratch folder in each round, the table of the round before is deleted then.

Kept are vectors with exactly `dim` components, none null or non-finite, and none beyond 2^27 after scaling (distances wouldn't fit 64 bits). Sums of components are exact up to 2^63, which over 6e10 members of the greatest magnitude reach.
Defined cases: null ids are kept and hash as the empty text; repeated rows count each; equal hashes go by components; fewer than k vectors give as many centroids; no kept vectors give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import map_batches
from quarry.session import drop_stored, stored

LIMIT = 1 << 27
FLOAT = 1 << 22  # up to here squared distances of 64 components are exact in doubles
STATE = "vec_id long, v array<int>, cluster int, distance long, compared int"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to one centroid, exact."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


@dataclass
class Balls:
    """centres: k rows of whole numbers; for each centroid its neighbours by distance, and from which squared distance on a member meets each."""

    centres: np.ndarray
    neighbours: list[np.ndarray]
    thresholds: list[np.ndarray]

    @classmethod
    def of(cls, centres: np.ndarray, radii: np.ndarray) -> Balls:
        """radii: upper bounds of the balls' radii; infinite where unknown, negative for balls without members."""
        near, least = [], []
        for i in range(len(centres)):
            apart = squared(centres, centres[i])
            mine = np.array([j for j in range(len(centres)) if j != i and float(apart[j]) <= (2 * radii[i]) ** 2 * (1 + 1e-9) + 1e-9 and radii[i] >= 0], np.int64)
            order = np.argsort(apart[mine], kind="stable")
            near.append(mine[order])
            least.append((apart[mine[order]] + 3) // 4)  # 4 * own >= apart, in whole numbers
        return cls(centres, near, least)

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: smaller number), squared distance, and how many centroids each row was compared with. own: the clusters so far."""
        big = max(int(np.abs(x).max(initial=0)), int(np.abs(self.centres).max(initial=0))) > FLOAT or x.shape[1] > 64
        kind = np.int64 if big else np.float64
        x, centres = x.astype(kind), self.centres.astype(kind)
        cluster, distance, compared = own.copy(), np.zeros(len(x), np.int64), np.ones(len(x), np.int32)
        for i in np.unique(own).tolist():
            rows = np.flatnonzero(own == i)
            d = squared(x[rows], centres[i]).astype(np.int64)
            best, name = d.copy(), np.full(len(rows), i)
            ring = np.searchsorted(self.thresholds[i], d, "right")  # 0: stable core; m: the m nearest neighbours are open
            for m, j in enumerate(self.neighbours[i].tolist()):
                at = np.flatnonzero(ring > m)
                if not len(at):
                    break
                other = squared(x[rows[at]], centres[j]).astype(np.int64)
                better = (other < best[at]) | ((other == best[at]) & (j < name[at]))
                best[at[better]], name[at[better]] = other[better], j
            cluster[rows], distance[rows], compared[rows] = name, best, ring + 1
        return cluster, distance, compared


def kept(vectors: DataFrame, vec_id: str, vector: str, dim: int, scale: float) -> DataFrame:
    """Stored (vec_id, v): the vectors in range, in whole numbers."""
    x = F.col("x")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.floor(F.least(F.greatest(v * scale, F.lit(-1e18)), F.lit(1e18))).between(-LIMIT, LIMIT)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where(x.isNotNull() & (F.size(x) == dim)).where(F.coalesce(fine, F.lit(False)))
    return stored(rows.select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("v")))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of 'seed:vec_id', in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r["v"] for r in rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], dtype=np.int64)


def assigned(state: DataFrame, balls: Balls, dim: int) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(balls)

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                cluster, distance, compared = shared.value.assign(matrix(part["v"], dim), part["cluster"].to_numpy().astype(np.int64))
                yield {"vec_id": part["vec_id"], "v": part["v"], "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance), "compared": pa.array(compared)}

        return step

    return map_batches(state.select("vec_id", "v", "cluster"), make, STATE)


def moved(state: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after an update, and bounds of their balls' radii."""
    dim = centres.shape[1]
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dim)]
    new, radii = centres.copy(), np.full(len(centres), -1.0)
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect():  # k rows
        c = r["cluster"]
        new[c] = [r[f"s{i}"] // r["n"] for i in range(dim)]
        radii[c] = (float(r["far"]) ** 0.5 + float(squared(new[c : c + 1], centres[c])[0]) ** 0.5) * (1 + 1e-9) + 1e-9
    return new, radii


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Stored (vec_id, v, cluster, distance, compared) after `rounds` updates and one more assignment, and the final centroids. compared: centroids that the last assignment compared the vector with."""
    state = kept(vectors, vec_id, vector, dim, scale)
    centres = first_centroids(state, k, seed)
    if not len(centres):
        return state.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("compared")), centres
    radii, before, state = np.full(len(centres), np.inf), state, state.withColumn("cluster", F.lit(0))  # one ball holds all at first
    for i in range(rounds + 1):
        state = stored(assigned(state, Balls.of(centres, radii), dim))
        drop_stored(before)
        before = state
        if i < rounds:
            centres, radii = moved(state, centres)
    return state, centres


def report(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared for every kept vector."""
    state, centres = cluster(vectors, k, rounds, dim, scale, seed)
    spark = vectors.sparkSession
    total = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # k rows
    most = (1 << 63) - 1
    name = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(i, min(total.get(i, 0), most), min(sum(total.values()), most), name(c)) for i, c in enumerate(centres)]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    return state.join(F.broadcast(spark.createDataFrame(rows, schema)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def _oracle(k: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    floor = "(({s} - (({s} % {n}) + {n}) % {n}) // {n})".format(s="sum(x)::bigint", n="count(*)")
    sql = [
        "k as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) v from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64)",
        f"c0 as materialized (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), v) - 1 c, v from k qualify c < {k})",
    ]
    for i in range(rounds + 1):
        sql.append(f"a{i} as materialized (select r, any_value(vec_id) vec_id, any_value(k.v) v, min({{'d': list_sum(list_transform(list_zip(k.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'c': c}}) m from k, c{i} group by r)")
        if i < rounds:
            sql.append(f"u{i} as (select m.c c, generate_subscripts(v, 1) p, unnest(v) x from a{i}), s{i} as (select c, list(x order by p) v from (select c, p, {floor} x from u{i} group by c, p) group by c), c{i + 1} as materialized (select c, coalesce(s{i}.v, c{i}.v) v from c{i} left join s{i} using (c))")
    return "with " + ",\n".join(sql) + f"\nselect vec_id, c::int cluster, m.d distance, (sum(m.d) over (partition by m.c))::bigint cluster_inertia, (sum(m.d) over ())::bigint inertia, sha256(array_to_string(c{rounds}.v, ',')) centroid_sha256 from a{rounds} join c{rounds} on m.c = c"


ORACLE = _oracle()
