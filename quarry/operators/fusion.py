"""Rank fusion, reranking, demotion and mood adjustment of ranked lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.text import DIGITS, whole_phrase

UPSTREAM = ("semantic_rrf", "semantic_score", "bm25_score", "rrf_score", "source_agreement", "final_score")


def rr(rank: Column, weight: float = 1.0, k: int = rules.RRF_K) -> Column:
    """Reciprocal-rank share of a 0-based rank; 0 where the list lacks the row."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank + 1), F.lit(0.0))


def filled(left: Column, right: Column, empty) -> Column:
    """left unless it is null or empty, then right."""
    return F.coalesce(F.nullif(left, F.lit(empty)), right, left)


def rrf(semantic: DataFrame, text: DataFrame, key: str = "id", extra: dict | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Full outer join of two ranked lists with their summed reciprocal ranks; a field of both is the left's unless empty (`extra`: field -> its empty value, None for null only). keep: more columns of the left list."""
    a, b = semantic.alias("a"), text.alias("b")
    cols = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    cols += [(F.coalesce(F.col(f"a.{n}"), F.col(f"b.{n}")) if e is None else filled(F.col(f"a.{n}"), F.col(f"b.{n}"), e)).alias(n) for n, e in (extra or {}).items()]
    cols += [F.col("a.semantic_score"), F.col("a.semantic_rank"), F.col("b.bm25_score"), F.col("b.bm25_rank"), *[F.col(f"a.{n}") for n in keep]]
    score = rr(F.col("a.semantic_rank"), rules.SEMANTIC_WEIGHT) + rr(F.col("b.bm25_rank"), rules.TEXT_WEIGHT)
    both = F.col("a.semantic_rank").isNotNull() & F.col("b.bm25_rank").isNotNull()
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*cols, F.round(score, DIGITS).alias("rrf_score"), F.when(both, 1.0).otherwise(0.0).alias("source_agreement"))


def rrf_lists(lists: list[DataFrame], key: str = "id", score: str = "semantic_score", rank: str = "semantic_rank", keep: str | None = None) -> DataFrame:
    """Fusion of lists of one kind: summed reciprocal ranks, the best score (with `keep` of its row, the earliest list's among equals), contiguous new ranks; equals go in the order in which the lists name them first."""
    out = None
    for i, x in enumerate(lists):
        part = x.select(key, F.col(score).alias("s"), F.col(rank).alias("r"), F.lit(i).alias("l"), *([F.col(keep).alias("k")] if keep else []))
        out = part if out is None else out.unionByName(part)
    best = [F.max_by("k", F.struct("s", -F.col("l"))).alias(keep)] if keep else []
    fused = out.groupBy(key).agg(F.round(F.sum(rr(F.col("r"))), DIGITS).alias("semantic_rrf"), F.max("s").alias(score), F.min(F.struct("l", "r")).alias("__first"), *best)
    return fused.withColumn(rank, F.row_number().over(Window.orderBy(F.desc("semantic_rrf"), "__first")) - 1).drop("__first")


def upstream() -> Column:
    """First score that isn't 0."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit(0.0)) for n in ("rrf_score", "semantic_rrf", "semantic_score", "bm25_score", "final_score")], F.lit(0.0))


def blend(pool: DataFrame, scored: str = "rerank_score", votes: str = "vote_count", by: tuple[str, ...] = ()) -> DataFrame:
    """Final score of a pool (one for each `by`) that has been cut already: rerank score plus shares of votes and of the upstream score, each relative to the pool's greatest."""
    names = set(pool.columns)
    for n in UPSTREAM:
        if n not in names:
            pool = pool.withColumn(n, F.lit(None).cast("double"))
    whole = Window.partitionBy(*(by or (F.lit(0),))).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = pool.withColumns({"quality_prior": F.log1p(F.greatest(F.coalesce(F.col(votes), F.lit(0)), F.lit(0)).cast("double")), "upstream_prior": upstream()})
    out = out.withColumns({n: F.coalesce(F.col(n) / F.nullif(F.max(n).over(whole), F.lit(0.0)), F.lit(0.0)) for n in ("quality_prior", "upstream_prior")})
    final = F.col(scored) + rules.VOTES_WEIGHT * F.col("quality_prior") + rules.UPSTREAM_WEIGHT * F.col("upstream_prior") + rules.AGREEMENT_BONUS * F.coalesce("source_agreement", F.lit(0.0))
    return out.withColumn("final_score", F.round(final, DIGITS)).drop(*(set(UPSTREAM) - {"final_score"} - names))


def demote(df: DataFrame, pos: str, dark: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """A permutation of a cut list (one for each `by`): dark rows last, both parts in their order; new positions from 0 in `pos`."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return df.withColumn("dark", F.coalesce(dark, F.lit(False))).withColumn(pos, F.row_number().over(w.orderBy("dark", pos)) - 1)


def is_dark(*texts: Column, phrases=rules.DARK_PHRASES) -> Column:
    return whole_phrase(F.lower(F.concat_ws(" ", *texts)), phrases)


def mood_order(df: DataFrame, pos: str, tags: str, desired: list[str], avoid: list[str]) -> DataFrame:
    """Positions moved up for desired and down for avoided tags, two counted at most; ties keep their order."""
    hits = lambda names: F.least(F.size(F.array_intersect(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in names]).cast("array<string>"))), F.lit(rules.COUNTED_HITS))
    moved = F.col(pos) - hits(desired) * rules.DESIRED_BONUS + hits(avoid) * rules.AVOID_PENALTY
    return df.withColumn("adjusted", moved).withColumn(pos, F.row_number().over(Window.orderBy("adjusted", pos)) - 1)


def intent_filter(year: Column, rating: Column, genres: Column, min_year=None, max_year=None, min_rating=None, include=(), exclude=()) -> Column:
    """Row predicate of an intent; genres: array. A year of 0 fails every least year and passes every greatest."""
    low = F.transform(F.coalesce(genres, F.array().cast("array<string>")), lambda g: F.lower(F.trim(g)))
    cond = F.lit(True)
    y = F.coalesce(year, F.lit(0))
    if min_year is not None:
        cond &= y >= min_year
    if max_year is not None:
        cond &= y <= max_year
    if min_rating is not None:
        cond &= F.coalesce(rating, F.lit(0.0)) >= min_rating
    if include:
        cond &= F.arrays_overlap(low, F.array(*[F.lit(g.lower()) for g in include]))
    if exclude:
        cond &= ~F.arrays_overlap(low, F.array(*[F.lit(g.lower()) for g in exclude]))
    return F.coalesce(cond, F.lit(False))


OPERATORS = {"$gte": lambda a, b: a >= b, "$lte": lambda a, b: a <= b, "$gt": lambda a, b: a > b, "$lt": lambda a, b: a < b}


def predicate(spec: dict, fields: dict[str, Column]) -> Column:
    """Compiles {field: {operator: value} or value}; unknown fields are ignored. Orders compare as numbers, and what isn't a number fails; $eq and plain values compare as they are."""
    cond = F.lit(True)
    for name, want in spec.items():
        if name not in fields:
            continue
        for op, value in (want if isinstance(want, dict) else {"$eq": want}).items():
            if op == "$eq":
                same = fields[name].cast("string") == value if isinstance(value, str) else fields[name].try_cast("double") == float(value)
                cond &= F.coalesce(same, F.lit(False))
            elif op in OPERATORS:
                cond &= F.coalesce(OPERATORS[op](fields[name].try_cast("double"), float(value)), F.lit(False))
    return cond


def match_reason(haystack: Column, genres: Column, tags: Column, plot: list[str], include: list[str], desired: list[str]) -> Column:
    """Why a row matched: plot terms found, genres asked for, moods shared."""
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    low = F.lower(haystack)
    found = F.filter(strings([p.strip() for p in plot if p.strip()]), lambda p: F.instr(low, F.lower(p)) > 0)
    mine = F.transform(genres, lambda g: F.lower(F.trim(g)))
    kinds = F.filter(strings([g.strip() for g in include if g.strip()]), lambda g: F.array_contains(mine, F.lower(g)))
    signals = F.concat(found, F.array_except(kinds, found))
    moods = F.array_sort(F.array_intersect(F.coalesce(tags, strings([])), strings(desired)))
    parts = F.concat_ws(" · ", F.when(F.size(signals) > 0, F.array_join(signals, ", ")), F.when(F.size(moods) > 0, F.array_join(moods, " · ")))
    return F.concat(F.lit("matches: "), F.when(parts == "", "content relevance").otherwise(parts))


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


#: (plural ending, what the word must be longer than)
PLURALS = (("ies", 5), ("es", 4), ("s", 3))


def _singular(word: str) -> str:
    return next((word[: -len(end)] for end, least in PLURALS if word.endswith(end) and len(word) > least), word)


def concepts(query: str) -> dict[str, str]:
    """Every spelling that counts as one of the query's concepts, with its concept: the query's content words without plural endings, and the members of each synonym group that these touch. A query has few."""
    asked = {_singular(w) for w in re.findall("[a-z0-9]+", query.lower()) if len(w) > 2 and w not in rules.EXPLAIN_STOPWORDS}
    wanted = asked.union(*(group for group in map(set, rules.EXPLAIN_SYNONYMS) if asked & group))
    spellings = ((c + end, c) for c in wanted for end in ("", *(end for end, _ in PLURALS)))
    return {w: c for w, c in spellings if _singular(w) == c and len(w) > 2 and w not in rules.EXPLAIN_STOPWORDS}


def explanation(query: str | Column, title: Column, genres: Column, overview: Column, keywords: Column, tagline: Column) -> Column:
    """Deterministic explanation from the row's own fields. The query's concepts are found once; a row only intersects its words with their spellings. query: a text, or a column with the concepts() of each row's query."""
    table = concepts(query) if isinstance(query, str) else {}
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    if table:
        spelled = F.array(*[F.lit(w) for w in sorted(table)])
        named = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
        found = lambda c: F.array_sort(F.array_distinct(F.transform(F.array_intersect(_words(c), spelled), lambda w: F.element_at(named, w))))
    elif not isinstance(query, str):
        found = lambda c: F.array_sort(F.array_distinct(F.transform(F.array_intersect(_words(c), F.map_keys(query)), lambda w: F.element_at(query, w))))
    else:
        found = lambda c: F.array().cast("array<string>")
    plot, kinds = found(F.concat_ws(" ", overview, keywords, tagline)), found(genres)
    name = F.when(blank(title) == "", "This movie").otherwise(blank(title))
    shared = lambda a, n: F.array_join(F.slice(a, 1, n), ", ")
    body = (
        F.when(blank(overview) == "", F.concat(name, F.lit(": weak match — overview is missing, so this is based on limited metadata.")))
        .when(F.size(plot) > 0, F.concat(name, F.lit(": overview, keywords, or tagline reference terms related to your query ("), shared(plot, 5), F.lit(").")))
        .when(F.size(kinds) > 0, F.concat(name, F.lit(": weak match — only the genre ("), shared(kinds, 3), F.lit(") overlaps your query; the overview does not describe these themes.")))
        .otherwise(F.concat(name, F.lit(": weak match — the overview, keywords, and tagline do not reference your query terms.")))
    )
    return F.concat_ws(" ", body, F.when((blank(genres) != "") & (F.size(kinds) == 0) & (F.size(plot) == 0), F.concat(F.lit("Genres: "), blank(genres), F.lit("."))))


def explained(df: DataFrame, query: str, pos: str = "pos", first: int = rules.EXPLAINED) -> DataFrame:
    """df with `explanation`: of the first rows by position, '' for all others. df has title, genres, overview, keywords and tagline."""
    text = explanation(query, *(F.col(n) for n in ("title", "genres", "overview", "keywords", "tagline")))
    return df.withColumn("explanation", F.when(F.col(pos) < first, text).otherwise(""))


def grounded(explanation_: Column, evidence: Column, strength: Column, query: Column, haystack: Column) -> Column:
    """The explanation if it has five words, a known strength, evidence that the row's text holds (none only for weak), and doesn't echo the query; else null."""
    e, v, s = F.trim(F.coalesce(explanation_, F.lit(""))), F.trim(F.coalesce(evidence, F.lit(""))), F.lower(F.trim(F.coalesce(strength, F.lit(""))))
    words = F.size(F.filter(F.split(e, r"\s+"), lambda w: w != ""))
    stripped = lambda c: F.regexp_replace(F.lower(c), r"^[.!? ]+|[.!? ]+$", "")
    echo = F.startswith(stripped(e), F.substring(stripped(query), 1, 40))
    ok = (words >= 5) & s.isin("strong", "moderate", "weak") & F.when(v != "", F.instr(F.lower(haystack), F.lower(v)) > 0).otherwise(s == "weak") & ~echo
    return F.when(ok, e)
