"""The retrieval pipelines as lazy plans: reading the query, text and vector lists, dedup at each step, fusion, rerank, demotion, explanations, filter, mood order.

A query is read on the driver (one literal row, folded without a job). Lists are cut before they meet the catalog, so what is broadcast is bounded by the cuts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.text import DIGITS, collapse, item_key
from quarry.operators import dedup, fusion, intent, vectors
from quarry.operators.index import TextIndex, query_terms, top

#: what a catalog row shows, with the value that counts as empty
SHOWN = {"title": "", "genres": "", "overview": "", "keywords": "", "tagline": "", "year": 0, "vote_count": 0, "vote_average": 0.0}
SCORES = ("semantic_score", "semantic_rank", "bm25_score", "bm25_rank", "rrf_score", "rerank_score", "final_score")


@dataclass
class Sources:
    """What a pipeline reads. catalog: id and the columns of SHOWN; movie_key is made where it lacks."""

    index: TextIndex
    vectors: DataFrame
    catalog: DataFrame

    def rows(self) -> DataFrame:
        c = self.catalog
        return c if "movie_key" in c.columns else c.withColumn("movie_key", item_key(F.col("title"), F.col("year"), F.col("id")))


@dataclass
class Reading:
    """What a query's text says."""

    retrieval: str
    rerank: str
    year_min: int | None
    year_max: int | None
    min_rating: float | None
    gentle: bool

    def allowed(self, year: Column, rating: Column) -> Column | None:
        """Predicate of the filters found, None without any."""
        spec: dict = {}
        for name, op, value in (("year", "$gte", self.year_min), ("year", "$lte", self.year_max), ("rating", "$gte", self.min_rating)):
            if value is not None:
                spec.setdefault(name, {})[op] = value
        return fusion.predicate(spec, {"year": year, "rating": rating}) if spec else None


def read(spark: SparkSession, query: str, rewrite: Callable[[str], str] | None = None) -> Reading:
    """Mood, filters and expansion of a query. Filters are read from the query itself; where it tells a feeling, retrieval goes by the rest of it. rewrite: a model's rewriting of the retrieval text, whose empty answer is ignored."""
    given = lambda x: spark.createDataFrame([(x,)], "q string")  # noqa: E731  a row, not a literal: folding these expressions takes the optimizer longer than running them
    row = intent.mood_intent(given(query or ""), "q", "m").withColumn("f", intent.parse_filters(F.col("q"))).select("q", "m.*", "f.*").first()
    wanted = row["cleaned_query"] if row["current_emotion"] is not None else row["q"]
    plain, expanded = given(wanted).select(collapse(F.col("q")), intent.expand_query(F.col("q"))).first()
    retrieval = given(rewrite(plain) or plain).select(intent.expand_query(F.col("q"))).first()[0] if rewrite and plain else expanded
    return Reading(retrieval if plain else "", expanded if plain else "", row["year_min"], row["year_max"], row["min_rating"], row["safety_sensitivity"] == "safe_hopeful")


def distinct(rows: DataFrame, prefer: str, pos: str) -> DataFrame:
    """One row for each movie_key: the first of greatest `prefer`, by the fallback scores where it lacks, with its gaps filled from the others."""
    has = [n for n in SCORES if n in rows.columns]
    score = F.col(prefer).cast("double")
    order = F.struct(score.isNotNull(), F.coalesce(score, *[F.col(n).cast("double") for n in reversed(SCORES) if n in has and not n.endswith("rank")]))
    return dedup.best_merge(rows, "movie_key", order, pos, {n: e for n, e in SHOWN.items() if n in rows.columns}, tuple(n for n in has if n != pos))


def semantic(vecs: DataFrame, query: list[float], k: int = rules.RETRIEVE_POOL, where: Column | None = None) -> DataFrame:
    """(id, semantic_score, semantic_rank) of the k most similar."""
    return vectors.search(vecs, query, k, where)


def text(index: TextIndex, query: str, k: int = rules.RETRIEVE_POOL, allowed: DataFrame | None = None, boosts: dict | None = None) -> DataFrame:
    """(id, bm25_score, bm25_rank); `allowed` ids are kept before the cut, collection statistics stay global."""
    hits = index.search(query_terms(index.postings.sparkSession, query), boosts or rules.FIELD_BOOSTS)
    return top(hits if allowed is None else hits.join(allowed, "id", "left_semi"), "bm25_score", "id", k, "bm25_rank")


def semantic_rows(src: Sources, vector: list[float], k: int, allowed: Column | None) -> DataFrame:
    """The k most similar allowed rows with their catalog columns, one for each movie_key; ranks are those before dedup."""
    vecs = src.vectors if allowed is None else src.vectors.join(src.catalog.where(allowed).select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    return distinct(src.rows().join(F.broadcast(semantic(vecs, vector, k)), "id"), "semantic_score", "semantic_rank")


def text_rows(src: Sources, query: str, k: int, allowed: Column | None) -> DataFrame:
    """The k best text hits of different movie_keys with their catalog columns; duplicates go before the cut and ranks are contiguous after it.

    Keys are found by a join of (id, movie_key) only: the hits are as many as documents that hold a term, so neither side is broadcast. The catalog's other columns are read for the chosen keys alone, where a gap is filled from a key's other hits.
    """
    rows = src.rows() if allowed is None else src.rows().where(allowed)
    hits = src.index.search(query_terms(src.index.postings.sparkSession, query), rules.FIELD_BOOSTS).withColumn("bm25_score", F.round("bm25_score", DIGITS))
    keyed = hits.join(rows.select("id", "movie_key"), "id").groupBy("movie_key").agg(F.max(F.struct("bm25_score", (-F.col("id")).alias("o"))).alias("b"))
    best = top(keyed.select("movie_key", (-F.col("b.o")).alias("id"), "b.bm25_score"), "bm25_score", "id", k, "bm25_rank")
    wide = rows.join(F.broadcast(best.select("movie_key", "bm25_rank")), "movie_key").join(hits, "id").withColumn("first", F.col("id"))
    return distinct(wide, "bm25_score", "first").drop("first")


def fuse(sem: DataFrame, txt: DataFrame, k: int) -> DataFrame:
    """The k rows of best summed reciprocal rank by movie_key; equals go in order of the semantic list, then of the text list. `first` is that order."""
    extra = {"id": None, **{n: e for n, e in SHOWN.items() if n in sem.columns and n in txt.columns}}
    both = fusion.rrf(sem, txt, "movie_key", extra, keep=("semantic_rrf",) if "semantic_rrf" in sem.columns else ())
    order = [F.desc("rrf_score"), F.col("semantic_rank").asc_nulls_last(), F.col("bm25_rank")]
    return both.orderBy(*order).limit(k).withColumn("first", F.row_number().over(Window.orderBy(*order)) - 1)


def basic(src: Sources, vector: list[float], k: int) -> DataFrame:
    """The k most similar rows, one for each movie_key."""
    return semantic_rows(src, vector, k, None)


def rerank(fused: DataFrame, score: Column, k: int, pool: int) -> DataFrame:
    """The first `pool` rows of a fused list scored and blended, the k best with `pos` from 0; equals keep their order. A fused list has one row for each movie_key, so nothing is left to deduplicate."""
    cut = fused.where(F.col("first") < pool).withColumn("final_score", F.col("rrf_score"))
    return top(fusion.blend(cut.withColumn("rerank_score", score)), "final_score", "first", k, "pos")


def finish(ranked: DataFrame, query: str, reading: Reading, dark: Column, explain: bool) -> DataFrame:
    """Dark rows last where the query asks for gentleness; explanations of the first rows."""
    out = fusion.demote(ranked, "pos", dark) if reading.gentle else ranked.withColumn("dark", F.lit(False))
    return fusion.explained(out, query) if explain else out.withColumn("explanation", F.lit(""))


def hybrid(src: Sources, query: str, embed: Callable[[str], list[float]], score: Callable[[str], Column], k: int, explain: bool = True, rewrite: Callable[[str], str] | None = None, dark: Column | None = None, retrieve: int = rules.RETRIEVE_POOL, fused: int = rules.FUSED_POOL, pool: int = rules.RERANK_POOL) -> DataFrame:
    """Both lists, deduplicated and fused, reranked by score(text of the rerank query), the k best in `pos`. An empty query has no rows. dark: what is demoted for a gentle query (the genres and keywords by default)."""
    return advanced(src, query, embed, score, k, explain, rewrite, None, dark, retrieve, fused, pool)


def advanced(src: Sources, query: str, embed: Callable[[str], list[float]], score: Callable[[str], Column], k: int, explain: bool = True, rewrite: Callable[[str], str] | None = None, imagine: Callable[[str], str] | None = None, dark: Column | None = None, retrieve: int = rules.RETRIEVE_POOL, fused: int = rules.FUSED_POOL, pool: int = rules.RERANK_POOL) -> DataFrame:
    """hybrid() whose semantic list is fused by rank from that of the query and that of an imagined document, if imagine(query) gives one."""
    spark = src.catalog.sparkSession
    reading = read(spark, query, rewrite)
    allowed = reading.allowed(F.col("year"), F.col("vote_average"))
    sem = semantic_rows(src, embed(reading.retrieval), retrieve, allowed)
    other = imagine(reading.rerank) if imagine else ""
    if other:
        lists = fusion.rrf_lists([sem, semantic_rows(src, embed(other), retrieve, allowed)], "movie_key", keep="id")
        sem = src.rows().join(F.broadcast(lists.drop("movie_key")), "id")
    both = fuse(sem, text_rows(src, reading.retrieval, retrieve, allowed), fused)
    ranked = rerank(both if reading.retrieval else both.limit(0), score(reading.rerank), k, pool)
    return finish(ranked, query, reading, fusion.is_dark(F.col("genres"), F.col("keywords")) if dark is None else dark, explain)


def recommend(ranked: DataFrame, keep: Column, desired: list[str], avoid: list[str], labels: DataFrame | None = None, reason: Column | None = None) -> DataFrame:
    """The intent's filter after the cut, tags by movie_key where a row has none (labels: movie_key, tags), why the row matched, mood order over the positions that are left.

    The list is cut already, so it is what is broadcast; the label map may be of any size.
    """
    left = ranked.where(keep)
    if labels is not None:
        found = labels.select("movie_key", F.col("tags").alias("__t")).join(F.broadcast(left.select("movie_key")), "movie_key", "left_semi")
        own = F.col("tags") if "tags" in left.columns else F.array().cast("array<string>")
        left = left.join(found, "movie_key", "left").withColumn("tags", F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.coalesce("__t", F.array().cast("array<string>")))).drop("__t")
    if reason is not None:
        left = left.withColumn("match_reason", reason)
    left = left.withColumn("pos", F.row_number().over(Window.orderBy("pos")) - 1)
    return fusion.mood_order(left, "pos", "tags", desired, avoid) if desired or avoid else left.withColumn("adjusted", F.col("pos"))
