"""The retrieval pipelines over a table of queries: every query in every mode in one run, each row keyed by its query.

The texts of all queries are read by the expressions that read one; retrieval reads the blocks of the index and of the vectors that can hold results (operators/blocks.py). Lists stay narrow (ids, keys, scores, ranks) until they are cut; the catalog's columns are fetched for what is left, where a row's gaps are filled from its key's other rows as the pipelines do for one query. Scores of texts are added in whole billionths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.text import DIGITS, collapse
from quarry.operators import dedup, fusion, intent
from quarry.operators.blocks import BlockIndex, VectorBlocks, leading
from quarry.operators.index import expanded, top
from quarry.plans.pipelines import SHOWN
from quarry.session import stored

#: a catalog row's columns that a query's filters restrict, and the reading's limits
LIMITS = ("year_min", "year_max", "vote_average_min")
MODE = ("qid", "mode")


@dataclass
class Sources:
    """blocks: an index whose rows have movie_key, year and vote_average; vectors: with the attributes year and vote_average; catalog: id and the columns of SHOWN."""

    blocks: BlockIndex
    vectors: VectorBlocks
    catalog: DataFrame

    @staticmethod
    def build(blocks: BlockIndex, vectors: DataFrame, catalog: DataFrame, size: int = 256) -> Sources:
        """catalog has movie_key."""
        known = vectors.join(catalog.select(F.col("id").alias("vec_id"), "year", "vote_average"), "vec_id", "left")
        return Sources(blocks, VectorBlocks.build(known, attributes=("year", "vote_average"), size=size), catalog)


def readings(queries: DataFrame) -> DataFrame:
    """Stored queries (qid, query, q and possibly q2, the vector of an imagined document) with what their texts say: retrieval, rerank, LIMITS, gentle, terms (of the rerank text), concepts."""
    concepts = F.udf(lambda q: sorted(fusion.concepts(q or "").items()), "array<struct<w:string,c:string>>", useArrow=True)  # of a few queries, once
    read = intent.mood_intent(queries.withColumn("query", F.coalesce("query", F.lit(""))), "query", "__m").withColumn("__f", intent.parse_filters(F.col("query")))
    wanted = F.when(F.col("__m.current_emotion").isNotNull(), F.col("__m.cleaned_query")).otherwise(F.col("query"))
    read = read.withColumn("__plain", collapse(wanted)).withColumn("rerank", F.when(F.col("__plain") != "", intent.expand_query(wanted)).otherwise(""))
    out = read.select(
        *queries.columns, F.col("rerank").alias("retrieval"), "rerank", F.col("__f.year_min"), F.col("__f.year_max"), F.col("__f.min_rating").alias("vote_average_min"), (F.col("__m.safety_sensitivity") == "safe_hopeful").alias("gentle"),
        expanded(F.col("rerank")).alias("terms"), F.map_from_entries(concepts("query")).alias("concepts"),
    )
    return stored(out)


def admitted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rows (qid, year, vote_average, ...) that their query's limits admit."""
    both = rows.join(asked.select("qid", *LIMITS), "qid")
    c = F.col
    fits = F.coalesce(c("year") >= c("year_min"), c("year_min").isNull()) & F.coalesce(c("year") <= c("year_max"), c("year_max").isNull()) & F.coalesce(c("vote_average") >= c("vote_average_min"), c("vote_average_min").isNull())
    return both.where(fits).drop(*LIMITS)


def semantic(src: Sources, asked: DataFrame, retrieve: int, k: int) -> DataFrame:
    """Stored (qid, list, id, movie_key, semantic_score, semantic_rank) of three lists: `plain` without limits (k rows), `query` and `imagined` with the query's limits (retrieve rows); ranks are those before dedup."""
    name = lambda x: F.struct("qid", F.lit(x).alias("list")).alias("qid")
    double = lambda c: F.col(c).cast("array<double>").alias("q")
    limits = [F.col(c).cast("double").alias(c) for c in LIMITS]
    lists = asked.select(name("plain"), double("q"), *[F.lit(None).cast("double").alias(c) for c in LIMITS]).unionByName(asked.select(name("query"), double("q"), *limits))
    if "q2" in asked.columns:
        lists = lists.unionByName(asked.where("q2 is not null").select(name("imagined"), double("q2"), *limits))
    found, _ = src.vectors.search(stored(lists.where("q is not null")), max(retrieve, k))
    cut = F.when(F.col("qid.list") == "plain", k).otherwise(retrieve)
    return stored(found.where(F.col("semantic_rank") < cut).select("qid.qid", "qid.list", "id", "semantic_score", "semantic_rank").join(src.blocks.rows.select("id", "movie_key"), "id"))


def merged_lists(lists: DataFrame) -> DataFrame:
    """(qid, mode, movie_key, id, semantic_score, semantic_rank) for the modes hybrid (the query's list) and advanced (fused with that of the imagined document, where there is one)."""
    best = lists.where("list <> 'plain'").groupBy("qid", "list", "movie_key").agg(F.min_by("id", "semantic_rank").alias("id"), F.max("semantic_score").alias("s"), F.min("semantic_rank").alias("r"))
    number = F.when(F.col("list") == "query", 0).otherwise(1)
    fused = best.groupBy("qid", "movie_key").agg(
        F.round(F.sum(fusion.rr(F.col("r"))), DIGITS).alias("f"), F.max("s").alias("semantic_score"), F.min(F.struct(number.alias("l"), "r")).alias("first"), F.max_by("id", F.struct("s", -number)).alias("id"), F.min(F.when(F.col("list") == "query", F.col("r"))).alias("own"),
        F.max_by("id", F.col("list") == "query").alias("own_id"), F.max(F.when(F.col("list") == "query", F.col("s"))).alias("own_s"),
    )
    both = best.where("list = 'imagined'").select("qid").distinct().withColumn("imagines", F.lit(True))
    w = Window.partitionBy("qid").orderBy(F.desc("f"), "first")
    fused = fused.withColumn("n", F.row_number().over(w) - 1).join(both, "qid", "left").withColumn("imagines", F.coalesce("imagines", F.lit(False)))
    hybrid = fused.where("own is not null").select("qid", F.lit("hybrid").alias("mode"), "movie_key", F.col("own_id").alias("id"), F.col("own_s").alias("semantic_score"), F.col("own").alias("semantic_rank"), F.lit(None).cast("double").alias("semantic_rrf"))
    advanced = fused.where("imagines or own is not null").select("qid", F.lit("advanced").alias("mode"), "movie_key", "id", "semantic_score", F.when(F.col("imagines"), F.col("n")).otherwise(F.col("own")).alias("semantic_rank"), F.when(F.col("imagines"), F.col("f")).alias("semantic_rrf"))
    return hybrid.unionByName(advanced)


def text(src: Sources, asked: DataFrame, retrieve: int) -> tuple[DataFrame, DataFrame]:
    """(qid, movie_key, id, bm25_score, bm25_rank) of the best `retrieve` keys of each query; and its stored terms (qid, term, qtf)."""
    terms = stored(asked.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")))
    hits, _ = src.blocks.search(terms, retrieve, "movie_key", lambda rows: admitted(rows, asked))
    best = hits.groupBy("qid", "movie_key").agg(F.max(F.struct("bm25_score", (-F.col("id")).alias("o"))).alias("b")).select("qid", "movie_key", (-F.col("b.o")).alias("id"), "b.bm25_score")
    return top(best, "bm25_score", "id", retrieve, "bm25_rank", ("qid",)), terms


def fuse(sem: DataFrame, txt: DataFrame, k: int) -> DataFrame:
    """Stored (qid, mode, movie_key, id, scores, ranks, first): the k rows of best summed reciprocal rank of each query and mode; equals go in order of the semantic list, then of the text list."""
    both = txt.withColumn("mode", F.explode(F.array(F.lit("hybrid"), F.lit("advanced"))))
    a, b = sem.alias("a"), both.alias("b")
    join = (F.col("a.qid") == F.col("b.qid")) & (F.col("a.mode") == F.col("b.mode")) & (F.col("a.movie_key") == F.col("b.movie_key"))
    score = fusion.rr(F.col("a.semantic_rank"), rules.SEMANTIC_WEIGHT) + fusion.rr(F.col("b.bm25_rank"), rules.TEXT_WEIGHT)
    rows = a.join(b, join, "full_outer").select(
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("qid", "mode", "movie_key", "id")], "a.semantic_score", "a.semantic_rank", "a.semantic_rrf", "b.bm25_score", "b.bm25_rank", F.round(score, DIGITS).alias("rrf_score"),
        F.when(F.col("a.semantic_rank").isNotNull() & F.col("b.bm25_rank").isNotNull(), 1.0).otherwise(0.0).alias("source_agreement"),
    )
    w = Window.partitionBy(*MODE).orderBy(F.desc("rrf_score"), F.col("semantic_rank").asc_nulls_last(), "bm25_rank")
    return stored(rows.withColumn("first", F.row_number().over(w) - 1).where(F.col("first") < k))


def shown(src: Sources, asked: DataFrame, pool: DataFrame, lists: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, mode, movie_key, the columns of SHOWN): a key's values from its best vector hit, its other vector hits, then its text hits; the advanced mode takes the best vector hit alone if it fuses lists."""
    keys = pool.select(*MODE, "movie_key", F.col("id").alias("own"), F.col("semantic_rrf").isNotNull().alias("alone"))
    near = lists.where("list = 'query'").select("qid", "movie_key", "id", (2 + F.col("semantic_score")).alias("prefer"), F.col("semantic_rank").cast("long").alias("o"))
    near = keys.where("not alone").join(near, ["qid", "movie_key"]).unionByName(keys.where("alone").join(pool.where("semantic_rank is not null").select(*MODE, "movie_key"), [*MODE, "movie_key"], "left_semi").select(*MODE, "movie_key", "own", "alone", F.col("own").alias("id"), F.lit(3.0).alias("prefer"), F.lit(0).cast("long").alias("o")))
    wanted = stored(admitted(keys.select("qid", "movie_key").distinct().join(src.blocks.rows.select("id", "block", "place", "movie_key", "year", "vote_average"), "movie_key"), asked).select("qid", "movie_key", "id", "block", "place"))
    again = src.blocks.scored(terms, wanted.select("qid", "block", "place")).join(wanted.select("qid", "id", "movie_key"), ["qid", "id"])
    found = keys.join(again.select("qid", "movie_key", "id", (F.col("bm25_score") / (1 + F.col("bm25_score"))).alias("prefer"), F.col("id").alias("o")), ["qid", "movie_key"])
    rows = stored(near.unionByName(found.select(near.columns)))
    own = src.catalog.select("id", *SHOWN).join(stored(rows.select("id").distinct()), "id", "left_semi")  # texts are shuffled for these ids only
    rows = rows.join(own, "id").withColumn("k", F.struct(*MODE, "movie_key"))
    merged = dedup.best_merge(rows.select("k", "prefer", "o", *SHOWN), "k", F.col("prefer"), "o", dict(SHOWN))
    return merged.select("k.*", *SHOWN)


def run(src: Sources, asked: DataFrame, k: int, score: Callable[[Column, Column], Column], retrieve: int = rules.RETRIEVE_POOL, fused: int = rules.FUSED_POOL, pool: int = rules.RERANK_POOL, dark: Column | None = None, basic_k: int | None = None) -> DataFrame:
    """(qid, mode, pos, id, movie_key, score, dark, explanation) of the modes basic, hybrid and advanced for every query of readings(). score(overview, terms): the rerank score. dark: what is demoted for a gentle query."""
    lists = semantic(src, asked, retrieve, basic_k or k)
    txt, terms = text(src, asked, retrieve)
    cut = fuse(merged_lists(lists), txt, min(fused, pool))
    said = asked.select("qid", "terms", "concepts", "gentle", (F.col("retrieval") != "").alias("says"))
    rows = cut.join(shown(src, asked, cut, lists, terms), [*MODE, "movie_key"]).join(said, "qid").where("says")
    scored = rows.withColumn("final_score", F.col("rrf_score")).withColumn("rerank_score", score(F.col("overview"), F.col("terms")))
    best = top(fusion.blend(scored, by=MODE), "final_score", "first", k, "pos", MODE)
    gloomy = fusion.is_dark(F.col("genres"), F.col("keywords")) if dark is None else dark
    out = fusion.demote(best, "pos", F.col("gentle") & gloomy, MODE)
    text_ = fusion.explanation(F.col("concepts"), *(F.col(n) for n in ("title", "genres", "overview", "keywords", "tagline")))
    out = out.select(*MODE, "pos", "id", "movie_key", F.col("final_score").alias("score"), "dark", F.when(F.col("pos") < rules.EXPLAINED, text_).otherwise("").alias("explanation"))
    near = lists.where("list = 'plain'").groupBy("qid", "movie_key").agg(F.min_by("id", "semantic_rank").alias("id"), F.max("semantic_score").alias("score"), F.min("semantic_rank").alias("r"))
    w = Window.partitionBy("qid").orderBy("r")
    plain = near.select("qid", F.lit("basic").alias("mode"), (F.row_number().over(w) - 1).alias("pos"), "id", "movie_key", "score", F.lit(False).alias("dark"), F.lit("").alias("explanation"))
    return out.unionByName(plain)
