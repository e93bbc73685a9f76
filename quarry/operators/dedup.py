"""Dedup of candidates: best row of a key with its gaps filled from the others, duplicate reports, tag unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_merge(df: DataFrame, key: str, prefer: Column, pos: str, fill: dict, scores: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the one of greatest preference, the earliest among equals. Its empty fields (`fill`: field -> empty value) and missing scores come from the next best rows. The position is the key's first.

    Aggregates only: rows of a key are combined before the shuffle, so a hot key costs no more than others.
    """
    names = df.columns
    order = F.struct(prefer.isNotNull(), prefer, -F.col(pos))
    best = lambda c, cond: F.max_by(F.when(cond, c), F.when(cond, order))
    rows = df.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(n).alias(n) for n in names if n != key]), order).alias("__v"), F.min(pos).alias("__first"),
        *[best(F.col(n), F.col(n).isNotNull() & (F.col(n) != e)).alias(f"__{n}") for n, e in fill.items()], *[best(F.col(n), F.col(n).isNotNull()).alias(f"__{n}") for n in scores],
    )
    own = {pos: F.col("__first")} | {n: F.coalesce(f"__{n}", f"__v.{n}") for n in (*fill, *scores)}
    return rows.select(*[F.col(n) if n == key else own.get(n, F.col(f"__v.{n}")).alias(n) for n in names])


def duplicates(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).where("n > 1")


def tag_union(df: DataFrame, key: str, tags: str, id_: str, order: str) -> DataFrame:
    """(key, id of the first row, sorted distinct tags of all rows). Tags are made distinct before they meet, so a hot key gathers its tags only."""
    first = df.groupBy(key).agg(F.min_by(id_, order).alias(id_))
    each = df.select(key, F.explode(tags).alias("t")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("t")).alias(tags))
    return first.join(each, key, "left").withColumn(tags, F.coalesce(tags, F.array().cast("array<string>")))
