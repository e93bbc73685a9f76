"""Range partitioning by explicit bounds, for operators that need a document's neighbour in id order without a global sort into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """Up to n - 1 values that split the key's range about evenly; at most n numbers reach the driver."""
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000)).first()[0]
    return sorted(set(got or []))


def bucket(key: Column, cuts: list[int]) -> Column:
    """How many of the cuts are below the key, as a balanced tree of comparisons."""
    if not cuts:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def spread(df: DataFrame, buckets: str, n: int) -> DataFrame:
    """One shuffle that puts every bucket (0 to n - 1) into one partition, different buckets into different ones."""
    spark = df.sparkSession
    token = spark.range(64 * n + 64).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    at = {r["p"]: r["id"] for r in token}
    if len(at) < n:
        return df.repartition(n, buckets)
    number = F.array(*[F.lit(int(at[i])) for i in range(n)])
    return df.withColumn("__part", F.element_at(number, F.col(buckets) + 1)).repartition(n, "__part").drop("__part")
