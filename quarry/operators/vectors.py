"""Exact cosine search over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import DIGITS
from quarry.operators.index import top


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; terms are added in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, clamped to 0..1."""
    return F.least(F.greatest(dot(a, b), F.lit(0.0)), F.lit(1.0))


def search(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, semantic_score, semantic_rank): the k most similar. The query is a literal, so the scan keeps its filters and pruned columns and nothing is shuffled but k rows a task."""
    df = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.select(F.col(id_).alias("id"), similarity(F.col(vector), q).alias("semantic_score"))
    return top(scored, "semantic_score", "id", k, "semantic_rank")


def search_many(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(qid, id, semantic_score, semantic_rank) for a stated set of query vectors (qid, q), by blocks: each worker multiplies its vectors with a block of queries and keeps k for each query before the shuffle.

    Queries are broadcast block by block, so memory is bounded by the block; every block reads all vectors. blocks.VectorBlocks reads those that can be among the k only.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(queries.schema["qid"].dataType)
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id long, semantic_score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")

    def part(block_rows: list) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in block_rows], np.array([r[1] for r in block_rows], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, m = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                s, keys = np.clip(m @ v.T, 0, 1).round(DIGITS), batch["id"].to_numpy()
                best = [np.lexsort((keys, -s[j]))[:k] for j in range(len(names))]
                yield pa.RecordBatch.from_pydict({
                    "qid": pa.array([n for n, at in zip(names, best) for _ in at], kind), "id": pa.array(np.concatenate([keys[at] for at in best])), "semantic_score": pa.array(np.concatenate([s[j, at] for j, at in enumerate(best)])),
                })

        return rows.mapInArrow(run, schema)

    parts, held = [], []
    for r in queries.select("qid", "q").orderBy("qid").toLocalIterator():
        held.append(r)
        if len(held) == block:
            parts.append(part(held))
            held = []
    if held:
        parts.append(part(held))
    if not parts:
        return vectors.sparkSession.createDataFrame([], schema + ", semantic_rank int")
    w = Window.partitionBy("qid").orderBy(F.desc("semantic_score"), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("semantic_rank", F.row_number().over(w) - 1).where(F.col("semantic_rank") < k)


def append_batches(df: DataFrame, path: str) -> None:
    """Writes vectors to a place that must not hold any yet."""
    df.write.mode("errorifexists").parquet(path)
