"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is a grouped minimum and a join; nothing is gathered on the driver but a checksum. Steps are cut by tables in the shared scratch folder, so a lost executor repeats one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import stored


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b). Self edges and repeats are allowed; no edges give no rows."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _checksum(now)
    while state[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = large.where("a <> b").distinct()
        down = pairs.groupBy("a").agg(F.min("b").alias("m"))
        small = pairs.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = stored(small.where("a <> b").distinct())
        before, state = state, _checksum(now)
        if before == state:
            break
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(now.select("b").distinct().join(now.select("a").distinct(), F.col("a") == F.col("b"), "left_anti").select(F.col("b").alias("node"), F.col("b").alias("component")))
