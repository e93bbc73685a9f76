"""Rendering and reading of model texts: rerank documents, prompts, canonical JSON, replies; result checks; per-mode evidence in long and map form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import collapse, to_double

#: fixed values: phrases of praise that say nothing about a row
GENERIC = ("great movie", "amazing film", "must watch", "must-watch", "critically acclaimed", "highly recommended", "iconic", "masterpiece", "won an oscar", "audiences love", "fans agree", "fans will love", "groundbreaking", "perfectly matches")


def rerank_document(title: Column, year: Column, genres: Column, tagline: Column, overview: Column, keywords: Column) -> Column:
    """One text of the non-empty fields for a cross-encoder; year 0 is unknown."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    part = lambda label, c, n=None, dot="": F.when(blank(c) != "", F.concat(F.lit(f"{label}: "), blank(c) if n is None else F.substring(blank(c), 1, n), F.lit(dot)))
    head = F.when(F.coalesce(year, F.lit(0)) > 0, F.concat(blank(title), F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(blank(title))
    return F.concat_ws(" ", F.when(blank(title) != "", F.concat(F.lit("Title: "), head, F.lit("."))), part("Genres", genres, None, "."), part("Tagline", tagline, 200), part("Overview", overview, 600), part("Keywords", keywords, 200))


def prompt(template: str, **fields: Column) -> Column:
    """The template with {name} places filled; null is empty."""
    out: list[Column] = []
    rest = template
    while rest:
        at = min((rest.find("{" + n + "}"), n) for n in fields if "{" + n + "}" in rest) if any("{" + n + "}" in rest for n in fields) else None
        if at is None:
            out.append(F.lit(rest))
            break
        if at[0]:
            out.append(F.lit(rest[: at[0]]))
        out.append(F.coalesce(fields[at[1]].cast("string"), F.lit("")))
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*out)


def numbered(items: Column) -> Column:
    """Lines `1. item` of an array."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def _sorted(value: Column, kind) -> Column:
    """The value with the fields of its structs, at every depth, in order of name."""
    if kind.typeName() == "struct":
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]))
    if kind.typeName() == "array" and kind.elementType.typeName() in ("struct", "array"):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    return value


def ascii_json(json: Column) -> Column:
    """A JSON text with every character beyond ASCII as \\u escapes, those beyond the basic plane as two."""

    def spelled(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))  # four digits, or eight of a pair
        escape = lambda at: F.concat(F.lit("\\u"), F.substring(units, at, 4))
        return F.when(ch.rlike(r"^[\x00-\x7F]$"), ch).otherwise(F.concat(escape(1), F.when(F.length(units) > 4, escape(5)).otherwise("")))

    return F.when(json.rlike(r"^[\x00-\x7F]*$"), json).otherwise(F.array_join(F.transform(F.split(json, ""), spelled), ""))


def canonical(df: DataFrame, *fields: str, ascii_only: bool = True) -> Column:
    """Compact JSON of the fields of df: keys sorted at every depth, nulls written, ASCII only unless told otherwise."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = F.to_json(F.struct(*[_sorted(F.col(n), kinds[n]).alias(n) for n in sorted(fields)]), {"ignoreNullFields": "false"})
    return ascii_json(out) if ascii_only else out


def extract_object(text: Column, schema: str) -> Column:
    """Best effort: the text itself, its widest braces, its first closed braces, parsed as an object of the schema; else null."""
    read = lambda c: F.when(F.trim(c).startswith("{") & F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return F.coalesce(read(text), read(F.regexp_extract(text, r"(?s)\{.*\}", 0)), read(F.regexp_extract(text, r"(?s)\{[^}]+\}", 0)))


def grade_reply(text: Column) -> Column:
    """struct(grade, confidence, reason, failure) of a grader's JSON reply; failure tells what is wrong first."""
    t = F.trim(F.coalesce(text, F.lit("")))
    get = lambda n: F.try_variant_get(F.try_parse_json(t), f"$.{n}", "string")
    parsed, kind = F.try_parse_json(t), F.schema_of_variant(F.try_parse_json(t))
    whole = F.when(F.try_variant_get(parsed, "$.grade", "double").isNotNull() & get("grade").rlike("^[0-3](\\.0+)?$") & ~F.coalesce(get("grade"), F.lit("")).isin("true", "false"), F.try_variant_get(parsed, "$.grade", "int"))
    text_reason = kind.rlike("reason: STRING")
    failure = (
        F.when(parsed.isNull(), "json_parse_error").when(~kind.startswith("OBJECT"), "json_parse_error: response is not an object").when(whole.isNull(), "invalid grade")
        .when(~F.coalesce(get("confidence").isin("high", "medium", "low"), F.lit(False)), "invalid confidence").when(~text_reason, "invalid reason")
    )
    ok = failure.isNull()
    return F.struct(F.when(ok, whole).alias("grade"), F.when(ok, get("confidence")).otherwise("low").alias("confidence"), F.when(ok, F.substring(collapse(get("reason")), 1, 240)).otherwise(failure).alias("reason"), failure.alias("failure"))


def hypothetical(reply: Column, least: int = 30, most: int = 800, quoted: bool = True) -> Column:
    """A prose reply without its quotes if its length is plausible, else ''. quoted=False: quotes at the ends belong to the text."""
    t = F.trim(F.coalesce(reply, F.lit("")))
    t = F.trim(F.regexp_replace(t, '^"+|"+$', "")) if quoted else t
    return F.when(F.length(t).between(least, most), t).otherwise("")


def unsupported(explanation: Column, overview: Column) -> Column:
    """True for praise that names none of the overview's first long words, and for disclaimers of another plot."""
    e = F.lower(F.coalesce(explanation, F.lit("")))
    generic = F.lit(False)
    for p in GENERIC:
        generic |= F.contains(e, F.lit(p))
    words = F.filter(F.slice(F.filter(F.split(F.lower(F.coalesce(overview, F.lit(""))), r"\s+"), lambda w: w != ""), 1, 30), lambda w: F.length(w) > 4)
    return (e != "") & ((generic & ~F.exists(words, lambda w: F.contains(e, w))) | F.contains(e, F.lit("same title")) | F.contains(e, F.lit("different plot")))


def health(results: DataFrame, k: int) -> DataFrame:
    """(qid, mode, problems): too few rows, repeated keys, repeated titles of a year, missing scores, generic explanations. results: qid, mode, movie_key, title, year, overview, explanation, final_score, rrf_score, rerank_score."""
    named = F.concat_ws("|", F.lower(F.trim(F.coalesce("title", F.lit("")))), F.coalesce(F.col("year").cast("string"), F.lit("")))
    n = results.groupBy("qid", "mode").agg(F.count("*").alias("n"), F.count_distinct("movie_key").alias("keys"), F.count_distinct(named).alias("titles"), F.count_if(unsupported(F.col("explanation"), F.col("overview"))).alias("generic"), F.count("final_score").alias("finals"), F.count("rrf_score").alias("fused"), F.count("rerank_score").alias("reranked"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("n") < min(k, 3), F.lit("too few")), F.when(F.col("keys") < F.col("n"), F.lit("duplicate keys")), F.when(F.col("titles") < F.col("n"), F.lit("duplicate title and year")), F.when(F.col("finals") < F.col("n"), F.lit("missing final_score")),
            F.when((F.col("mode") == "hybrid") & (F.col("fused") == 0), F.lit("no rrf_score")), F.when(F.col("mode").isin("advanced", "hybrid") & (F.col("reranked") == 0), F.lit("no rerank_score")), F.when(F.col("generic") > 0, F.lit("generic explanation")),
        )
    )
    return n.select("qid", "mode", problems.alias("problems")).where(F.size("problems") > 0)


#: fixed values: the scores of a mode's evidence
SCORES = ("final_score", "rerank_score", "rrf_score", "bm25_score", "semantic_score")


def to_modes(rows: DataFrame, modes: tuple[str, ...], scores: tuple[str, ...] = SCORES) -> DataFrame:
    """(qid, id, per_mode): evidence as a map in the fixed order of modes: the rank and, of `scores`, the columns that rows have. A null score stays null and is left out when the evidence is written as JSON; one that is no finite number is 0."""
    here = [n for n in scores if n in rows.columns]
    rows = rows.select(*rows.columns, *[F.when(F.col(n).isNotNull(), to_double(F.col(n))).alias(f"__{n}") for n in here])
    number = F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode"))
    entry = F.struct(number.alias("n"), F.col("mode").alias("key"), F.struct("rank", *[F.col(f"__{n}").alias(n) for n in here]).alias("value"))
    return rows.groupBy("qid", "id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["key"], e["value"]))).alias("per_mode"))


def from_modes(rows: DataFrame) -> DataFrame:
    """The long form of to_modes()."""
    return rows.select("qid", "id", F.explode("per_mode").alias("mode", "v")).select("qid", "id", "mode", "v.*")


def unjudged_top(rows: DataFrame, k: int = 5) -> DataFrame:
    """(qid, mode, id) of rows in some mode's top k without a grade."""
    return rows.where((F.col("rank") < k) & F.col("grade").isNull()).select("qid", "mode", "id")


def every_nth(df: DataFrame, number: str, n: int) -> DataFrame:
    """Rows 1, n + 1, 2n + 1 ... of a list that carries its rows' numbers from 1, as a file's line numbers. The sampling is the operator's purpose."""
    return df.where((F.col(number) - 1) % n == 0)
