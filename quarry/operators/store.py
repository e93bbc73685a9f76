"""Browse, paging, random pick, history, library state, result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.text import uniform
from quarry.operators.render import canonical

#: fixed values: (label, first year, last year)
ERAS = (("Before 1980", None, 1979), ("1980s", 1980, 1989), ("1990s", 1990, 1999), ("2000s", 2000, 2009), ("2010s", 2010, 2019), ("2020s", 2020, 2029))

SORTS = {
    "popularity": ("votes", "rating"),
    "rating": ("rating", "votes"),
    "year": ("year", "votes"),
}


def browse(sort: str) -> list[Column]:
    """Total order of a browse list; ValueError for an unknown sort."""
    if sort not in SORTS:
        raise ValueError(f"unsupported sort: {sort}")
    return [F.desc(n) for n in SORTS[sort]] + [F.lower("title"), F.col("id")]


def browse_filter(genre: str | None = None, min_year: int | None = None, max_year: int | None = None) -> Column:
    cond = F.lit(True)
    if genre:
        cond &= F.array_contains(F.transform("genres", lambda g: F.lower(g)), genre.lower())
    if min_year is not None:
        cond &= F.col("year") >= min_year
    if max_year is not None:
        cond &= F.col("year") <= max_year
    return F.coalesce(cond, F.lit(False))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` from 1: a top-k plan of the rows up to its end, then an offset; nothing is sorted whole."""
    return df.orderBy(*order).limit(number * size).orderBy(*order).offset((number - 1) * size)


def reroll(number: int, pages: int) -> int:
    return number % max(pages, 1) + 1


def quality_floor(min_votes: int = 200, min_rating: float = 6.0) -> Column:
    return (F.col("votes") >= min_votes) & (F.col("rating") >= min_rating)


def random_pick(df: DataFrame, seed: str, k: int = 1) -> DataFrame:
    """k rows drawn without replacement with weights max(votes, 1): exponential keys from a hash of the id."""
    key = -F.log(uniform(seed, F.col("id"))) / F.greatest(F.col("votes"), F.lit(1))
    return df.withColumn("draw", F.round(key, 12)).orderBy("draw", "id").limit(k)


def genre_list(df: DataFrame) -> DataFrame:
    return df.select(F.explode("genres").alias("genre")).distinct().orderBy(F.lower("genre"), "genre")


def era_of(year: Column) -> Column:
    """Label of the first era that holds the year; an unknown year counts as 0."""
    y = F.coalesce(year, F.lit(0))
    return F.coalesce(*[F.when((y <= last) if first is None else y.between(first, last), label) for label, first, last in ERAS])


def recent(df: DataFrame, ts: str, id_: str, k: int = 50) -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(id_)).limit(k)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str, keep_first: tuple[str, ...] = ("id", "added_at")) -> DataFrame:
    """Latest values of each key; the kept fields stay as first written."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c != key and c not in keep_first]
    return rows.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in keep_first if c in rows.columns], F.max_by(F.struct(*rest), order).alias("v")).select(key, *[c for c in keep_first if c in rows.columns], *[F.col(f"v.{c}").alias(c) for c in rest])


def toggled(events: DataFrame, key: list[str], ts: str) -> DataFrame:
    """(key, watched, watched_at): odd numbers of toggles mean watched, since the last toggle."""
    n = events.groupBy(*key).agg(F.count("*").alias("toggles"), F.max(ts).alias("last"))
    on = F.col("toggles") % 2 == 1
    return n.select(*key, on.alias("watched"), F.when(on, F.col("last")).alias("watched_at"))


def fold_events(events: DataFrame, key: list[str], ts: str, id_: str, kind: str) -> DataFrame:
    """Live keys after puts and deletes: the last event decides."""
    return events.groupBy(*key).agg(F.max_by(kind, F.struct(ts, id_)).alias("last")).where("last <> 'delete'").drop("last")


def cache_key(request: DataFrame, *fields: str) -> Column:
    """Hash of the canonical rendering of a request's fields: sorted keys at every depth, ASCII only, so that neither the caller's order nor the encoding matters."""
    return F.sha2(canonical(request, *fields), 256)


def live(cache: DataFrame, now: Column, keys: list[str], created: str = "created_at", ttl: Column | None = None) -> DataFrame:
    """Of each key the last write (the greatest row among equal times), if it hasn't expired."""
    seconds = F.lit(rules.CACHE_SECONDS) if ttl is None else ttl
    rest = [c for c in cache.columns if c not in keys and c != created]
    last = cache.groupBy(*keys).agg(F.max(F.struct(created, *rest)).alias("__v")).select(*keys, "__v.*").select(*cache.columns)
    return last.where(F.unix_micros(F.col(created).cast("timestamp")) + seconds * 1_000_000 > F.unix_micros(now.cast("timestamp")))


def watch_filter(which: str, watched: Column) -> Column:
    """Predicate of a library view: all, watched or unwatched."""
    views = {"all": F.lit(True), "watched": F.coalesce(watched, F.lit(False)), "unwatched": ~F.coalesce(watched, F.lit(False))}
    if which not in views:
        raise ValueError(f"unsupported view: {which}")
    return views[which]
