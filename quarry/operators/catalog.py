"""Catalog ingest: cleaning, filtering, keep-first dedup, embedding documents, metadata rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import clean_list, clip, decade, is_true, loose_list, safe_text, to_double, to_int, year_of, year_or

#: fixed values: the columns of a raw catalog
COLUMNS = ("id", "title", "vote_average", "vote_count", "status", "release_date", "runtime", "adult", "homepage", "original_language", "original_title", "overview", "popularity", "poster_path", "tagline", "genres", "production_companies", "spoken_languages", "keywords")
LISTS = ("genres", "keywords", "production_companies", "spoken_languages")


def require(df: DataFrame, names) -> DataFrame:
    """df pruned to the named columns; ValueError names those that lack."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df.select(*names)


def cleaned(raw: DataFrame) -> DataFrame:
    """Typed columns: texts trimmed, numbers coerced, year and decade derived, genres and keywords also as normalised lists (_clean). Other columns pass."""
    c = F.col
    text = ("title", "status", "release_date", "homepage", "original_language", "original_title", "overview", "poster_path", "tagline")
    out = raw.withColumns({n: safe_text(c(n)) for n in (*text, *LISTS)})
    out = out.withColumns({"id": c("id").try_cast("double").cast("long"), "vote_average": to_double(c("vote_average")), "vote_count": to_int(c("vote_count")), "popularity": to_double(c("popularity")), "runtime": to_double(c("runtime"), None), "adult": is_true(c("adult"))})
    out = out.withColumn("year", year_of(c("release_date")))
    return out.withColumns({"decade": decade(c("year")), "genres_clean": clean_list(c("genres")), "keywords_clean": clean_list(c("keywords"))})


def eligible(df: DataFrame, min_overview: int = 50, min_votes: int = 50, languages: tuple[str, ...] = ()) -> DataFrame:
    """Released, not adult, with a title, a long enough overview and enough votes; languages: lower-case codes, all if empty."""
    cond = F.col("id").isNotNull() & (F.col("title") != "") & (F.length("overview") >= min_overview) & (F.lower("status") == "released") & ~F.col("adult") & (F.col("vote_count") >= min_votes)
    if languages:
        cond &= F.lower("original_language").isin(*languages)
    return df.where(cond)


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order. An aggregate: a key's rows are combined before the shuffle."""
    rows = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__v"))
    return rows.select("__v.*")


def embedding_document() -> Column:
    """Labelled lines of the non-empty fields; the title's line is always there."""
    c = F.col

    def line(label: str, value: Column, cond: Column) -> Column:
        return F.when(cond, F.concat(F.lit(f"{label}: "), value))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), c("title")),
        line("Original title", c("original_title"), (c("original_title") != "") & (c("original_title") != c("title"))),
        line("Year", F.concat(c("year").cast("string"), F.lit(" ("), c("decade"), F.lit(")")), c("year").isNotNull()),
        line("Genres", c("genres_clean"), c("genres_clean") != ""),
        line("Tagline", c("tagline"), c("tagline") != ""),
        line("Plot", c("overview"), c("overview") != ""),
        line("Themes and topics", c("keywords_clean"), c("keywords_clean") != ""),
    )


def build_catalog(raw: DataFrame, order: list[Column], **limits) -> DataFrame:
    """The clean catalog with documents; of rows with the same lower-cased title and year the first in order stays."""
    df = eligible(cleaned(require(raw, [*COLUMNS, *[x for x in raw.columns if x not in COLUMNS]])), **limits)
    df = keep_first(df, [F.lower(F.trim("title")), F.coalesce("year", F.lit(0))], order)
    return df.withColumn("document", embedding_document())


#: fixed values: field of the metadata row: (source, greatest length)
CLIPS = {
    "title": ("title", 300), "original_title": ("original_title", 300), "original_language": ("original_language", 20), "genres": ("genres", 500), "genres_clean": ("genres_clean", 300),
    "release_date": ("release_date", 50), "poster_path": ("poster_path", 300), "overview": ("overview", 700), "tagline": ("tagline", 300), "keywords": ("keywords_clean", 500),
}


def metadata(df: DataFrame) -> DataFrame:
    """Flat row for a vector store: clipped texts, defaulted numbers, a stable text id. A row with a document but without a positive id fails the plan, since its vector would have no row; rows without a document go."""
    key = F.when(F.coalesce(F.col("id"), F.lit(0)) > 0, F.concat(F.lit("tmdb_"), F.col("id").cast("string"))).otherwise(F.raise_error(F.lit("a document has no positive id")))
    return df.where(F.coalesce("document", F.lit("")) != "").select(
        key.alias("vec_key"), F.col("id").alias("tmdb_id"), *[clip(F.col(c), k).alias(n) for n, (c, k) in CLIPS.items()],
        F.coalesce("year", F.lit(0)).alias("year"), to_int(F.col("runtime")).alias("runtime"), to_double(F.col("vote_average")).alias("vote_average"), to_int(F.col("vote_count")).alias("vote_count"), to_double(F.col("popularity")).alias("popularity"),
    )


def drift(df: DataFrame, rows: int, votes: int) -> DataFrame:
    """Row count and least votes against what is expected."""
    return df.agg(F.count("*").alias("rows"), F.min("vote_count").alias("min_votes")).withColumns({"rows_ok": F.col("rows") == rows, "votes_ok": F.coalesce(F.col("min_votes") >= votes, F.lit(False))})


def profile(df: DataFrame) -> DataFrame:
    """The row an application shows: real id (the first of tmdb_id, movie_id and id that df has and that isn't empty), key, parsed lists, defaulted numbers, no tags yet. Columns that df lacks are empty."""
    col = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    text = lambda n: F.coalesce(col(n).cast("string"), F.lit(""))
    real = to_int(F.coalesce(*[F.nullif(col(n).cast("string"), F.lit("")) for n in ("tmdb_id", "movie_id", "id")]))
    listed = lambda n: col(n) if n in df.columns and df.schema[n].dataType.typeName() == "array" else loose_list(col(n).cast("string"))
    year = year_or(to_int(col("year").cast("string")), text("release_date"))
    strings = F.array().cast("array<string>")
    return df.select(
        real.alias("tmdb_id"), F.concat(F.lit("movie_id:"), real.cast("string")).alias("movie_key"), text("title").alias("title"), year.alias("year"), listed("genres").alias("genres"), text("overview").alias("overview"), listed("keywords").alias("keywords"), text("tagline").alias("tagline"),
        to_double(col("vote_average")).alias("vote_average"), to_int(col("vote_count").cast("string")).alias("vote_count"), to_double(col("popularity")).alias("popularity"), text("poster_path").alias("poster_path"), text("backdrop_path").alias("backdrop_path"), strings.alias("film_mood_tags"),
        F.struct(F.lit(0.0).alias("darkness"), F.lit(0.0).alias("intensity")).alias("tone_scores"),
    )


def candidate(df: DataFrame, overview: int = 500) -> DataFrame:
    """The row a text hit carries: clipped overview, defaulted texts and numbers, year with its fallback."""
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    return df.select(
        "id", text("title").alias("title"), text("release_date").alias("release_date"), year_or(F.col("year"), text("release_date")).alias("year"), F.coalesce("genres_clean", "genres", F.lit("")).alias("genres"), clip(F.col("overview"), overview).alias("overview"), text("poster_path").alias("poster_path"),
        to_double(F.col("vote_average")).alias("vote_average"), to_int(F.col("vote_count").cast("string")).alias("vote_count"), F.coalesce("keywords_clean", F.lit("")).alias("keywords"), text("tagline").alias("tagline"),
    )
