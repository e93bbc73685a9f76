"""Validators of stored records: one pass that parses each line once and lists every message, in the order in which a reader would meet them.

Lines are JSON texts. A record is valid if its list is empty; gates() over several tables do the same for vocabularies, rules and labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import rules

# --- fixed values: closed vocabularies of query records ---
ERAS = ("pre-1980", "1980-2000", "2000-2015", "2015+")
GENRES = ("drama", "thriller", "sf", "animation", "horror", "comedy", "action", "romance", "documentary", "other")
LEVELS = ("high", "low", "medium")
LENGTHS = ("long", "medium", "short")
MOODS = {
    "current_emotion": ("anxious", "bored", "heartbroken", "lonely", "sad", "stressed", "tired"),
    "desired_direction": ("calm_me_down", "cheer_me_up", "comfort_me", "give_me_hope", "help_me_cry", "make_me_laugh", "motivate_me"),
    "energy_level": ("emotional_but_safe", "funny_energetic", "light_cozy", "slow_gentle"),
    "intensity": ("heavy_but_requested", "medium_emotional", "very_light"),
    "safety_sensitivity": ("dark_intended", "neutral", "safe_hopeful"),
}
MODES = ("advanced", "basic", "hybrid")
CONFIDENCES = ("high", "low", "medium")


class Line:
    """A parsed JSON text and the checks that can be made on its parts. Every check gives a message, or null where it holds."""

    def __init__(self, text: Column) -> None:
        self.value = F.try_parse_json(text)
        self.keys = F.map_keys(F.from_json(text, "map<string,string>"))
        self.is_object = F.coalesce(F.schema_of_variant(self.value).startswith("OBJECT"), F.lit(False))

    def part(self, path: str) -> Column:
        return F.try_variant_get(self.value, f"$.{path}", "variant")

    def kind(self, path: str) -> Column:
        """STRING, BIGINT, BOOLEAN, VOID, OBJECT..., ARRAY..., DECIMAL..., DOUBLE; null where there is no such key."""
        return F.schema_of_variant(self.part(path))

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.value, f"$.{path}", "string"))

    def number(self, path: str) -> Column:
        return F.when(self.kind(path) == "BIGINT", F.try_variant_get(self.value, f"$.{path}", "bigint"))

    def _typed(self, path: str, ok: Column, what: str) -> Column:
        kind = self.kind(path)
        return F.when(kind.isNull(), F.lit(f"{path} is required")).when(~F.coalesce(ok, F.lit(False)), F.lit(f"{path} must be {what}"))

    def string(self, path: str) -> Column:
        return self._typed(path, self.kind(path) == "STRING", "a string")

    def integer(self, path: str) -> Column:
        return self._typed(path, self.kind(path) == "BIGINT", "an integer")

    def object(self, path: str) -> Column:
        return self._typed(path, self.kind(path).startswith("OBJECT"), "an object")

    def one_of(self, path: str, allowed: tuple[str, ...], null: bool = False) -> Column:
        ok = F.coalesce(self.text(path).isin(*allowed), F.lit(False))
        return self._typed(path, ok | (self.kind(path) == "VOID") if null else ok, "one of: " + ", ".join(sorted(allowed)))

    def longest(self, path: str, n: int) -> Column:
        return F.when(F.length(self.text(path)) > n, F.lit(f"{path} must be <= {n} characters"))

    def unexpected(self, allowed: tuple[str, ...], name: str, path: str | None = None) -> Column:
        keys = self.keys if path is None else F.map_keys(F.from_json(F.to_json(self.part(path)), "map<string,string>"))
        extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in allowed])))
        return F.when(F.size(extra) > 0, F.concat(F.lit(f"{name} has unexpected keys: "), F.array_join(extra, ", ")))

    def listed(self, checks: list[Column], name: str) -> Column:
        """The messages of a record; one only if it is no object."""
        found = F.array_compact(F.array(*checks))
        return F.when(self.is_object, found).otherwise(F.array(F.lit(f"{name} must be an object")))


def query_errors(text: Column, moods: bool = False, last: int | None = None) -> Column:
    """Messages of an evaluation query; moods: the second form, whose era may be null and whose tags may hold a mood. Ids are q01 to q<last>, 20 in the first form and 65 in the second unless told otherwise."""
    r, ids = Line(text), tuple(f"q{i:02d}" for i in range(1, (last or (65 if moods else 20)) + 1))
    tags = ("era", "genre", "vocab_distance", "length", "specificity", "ambiguity", *(("mood",) if moods else ()))
    in_range = F.coalesce(r.text("qid").isin(*ids), F.lit(False))
    genres = F.when(r.kind("tags.genre").startswith("ARRAY"), F.try_variant_get(r.value, "$.tags.genre", "array<variant>"))
    bad_genre = F.filter(F.transform(genres, lambda g, i: F.when(~(F.schema_of_variant(g) == "STRING"), F.concat(F.lit("tags.genre["), i, F.lit("] must be a string"))).when(~F.try_variant_get(g, "$", "string").isin(*GENRES), F.concat(F.lit("tags.genre["), i, F.lit("] must be one of: " + ", ".join(sorted(GENRES)))))), lambda x: x.isNotNull())
    no_genre = F.when(r.kind("tags.genre").isNull(), "tags.genre is required").when(genres.isNull() | (F.size(genres) == 0), "tags.genre must be a non-empty list")
    checks = [
        r.unexpected(("qid", "query", "tags", "notes"), "query record"), r.string("qid"), F.when(r.text("qid").isNotNull() & ~in_range, F.lit(f"qid must be one of: {ids[0]} to {ids[-1]}")), r.string("query"), r.string("notes"), r.longest("notes", 200), r.object("tags"),
    ]
    inner = [
        r.unexpected(tags, "tags", "tags"), r.one_of("tags.era", ERAS, null=moods), r.one_of("tags.vocab_distance", LEVELS), r.one_of("tags.length", LENGTHS), r.one_of("tags.specificity", LEVELS), r.one_of("tags.ambiguity", LEVELS), no_genre, F.get(bad_genre, F.lit(0)),
    ]
    if moods:
        has, is_map = F.coalesce(~r.kind("tags.mood").isin("VOID"), F.lit(False)), F.coalesce(r.kind("tags.mood").startswith("OBJECT"), F.lit(False))
        inner += [F.when(has & ~is_map, "tags.mood must be an object"), F.when(is_map, r.unexpected(tuple(MOODS), "tags.mood", "tags.mood"))]
        inner += [F.when(is_map, r.one_of(f"tags.mood.{n}", allowed)) for n, allowed in MOODS.items()]
    has_tags = F.coalesce(r.kind("tags").startswith("OBJECT"), F.lit(False))
    return r.listed(checks + [F.when(has_tags, c) for c in inner], "query record")


def candidate_errors(text: Column) -> Column:
    """Messages of a candidate record: typed fields, evidence for each mode, and the modes that have it in their top."""
    r = Line(text)
    names = ("qid", "movie_key", "title", "overview", "genres", "keywords", "tagline")
    modes = F.map_entries(F.when(r.kind("per_mode").startswith("OBJECT"), F.try_variant_get(r.value, "$.per_mode", "map<string,variant>")))
    known = F.array(*[F.lit(m) for m in MODES])

    def evidence(e: Column) -> Column:
        name, kind = F.concat(F.lit("per_mode."), e["key"]), F.schema_of_variant(e["value"])
        fields = F.map_entries(F.try_variant_get(e["value"], "$", "map<string,variant>"))
        rank = F.try_variant_get(e["value"], "$.rank", "variant")
        other = F.get(F.filter(fields, lambda f: (f["key"] != "rank") & ~F.schema_of_variant(f["value"]).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.lit(0))
        return (
            F.when(~F.array_contains(known, e["key"]), F.concat(F.lit("per_mode has unexpected mode: "), e["key"])).when(kind == "VOID", F.concat(name, F.lit(" must be an object, not None"))).when(~kind.startswith("OBJECT"), F.concat(name, F.lit(" must be an object")))
            .when(rank.isNull(), F.concat(name, F.lit(".rank is required"))).when(~(F.schema_of_variant(rank) == "BIGINT"), F.concat(name, F.lit(".rank must be an integer"))).when(F.try_variant_get(rank, "$", "bigint") < 0, F.concat(name, F.lit(".rank must be >= 0")))
            .when(other.isNotNull(), F.concat(name, F.lit("."), other["key"], F.lit(" must be a number")))
        )

    tops = F.when(r.kind("in_top_k_of").startswith("ARRAY"), F.try_variant_get(r.value, "$.in_top_k_of", "array<variant>"))

    def top(m: Column, i: Column) -> Column:
        at, name = F.concat(F.lit("in_top_k_of["), i, F.lit("]")), F.try_variant_get(m, "$", "string")
        return (
            F.when(~(F.schema_of_variant(m) == "STRING"), F.concat(at, F.lit(" must be a string"))).when(~F.array_contains(known, name), F.concat(at, F.lit(" must be one of: " + ", ".join(MODES))))
            .when(~F.exists(modes, lambda e: e["key"] == name), F.concat(at, F.lit(" must also appear in per_mode")))
        )

    first = lambda a: F.get(F.filter(a, lambda x: x.isNotNull()), F.lit(0))
    return r.listed(
        [
            r.unexpected((*names, "tmdb_id", "year", "per_mode", "in_top_k_of", "source"), "candidate record"), *[r.integer(n) if n in ("tmdb_id", "year") else r.string(n) for n in ("qid", "tmdb_id", "movie_key", "title", "year", "overview", "genres", "keywords", "tagline", "source")],
            F.when(r.text("source").isNotNull() & (r.text("source") != "union"), 'source must be "union"'), r.object("per_mode"), F.when(F.size(modes) == 0, "per_mode must contain at least one mode"), first(F.transform(modes, evidence)),
            F.when(r.kind("in_top_k_of").isNull(), "in_top_k_of is required").when(tops.isNull(), "in_top_k_of must be a list"), first(F.transform(tops, top)),
        ],
        "candidate record",
    )


def label_errors(text: Column) -> Column:
    """Messages of a model's label: grade 0 to 3 or null (then of low confidence), a short reason, a UTC time to the second."""
    r = Line(text)
    kind, ts = r.kind("grade"), r.text("ts")
    no_grade = kind == "VOID"
    whole = F.coalesce(F.try_variant_get(r.value, "$.grade", "double").isin(0.0, 1.0, 2.0, 3.0) & kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    return r.listed(
        [
            r.unexpected(("qid", "tmdb_id", "grade", "confidence", "reason", "model", "ts"), "silver record"), r.string("qid"), r.integer("tmdb_id"), F.when(kind.isNull(), "grade is required").when(~no_grade & ~whole, "grade must be one of: 0, 1, 2, 3, None"), r.one_of("confidence", CONFIDENCES),
            F.when(no_grade & r.text("confidence").isin("high", "medium"), 'confidence must be "low" when grade is None'), r.string("reason"), r.longest("reason", 240), r.string("model"), r.string("ts"),
            F.when(~ts.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"), "ts must be ISO-8601 UTC second precision ending in Z").when(F.try_to_timestamp(ts, F.lit("yyyy-MM-dd'T'HH:mm:ssX")).isNull(), "ts must be parseable ISO-8601"),
        ],
        "silver record",
    )


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(value, side) of what only one of two one-column tables holds: `missing` stands in left only, `extra` in right only."""
    a, b = (d.toDF("value").distinct() for d in (left, right))
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def vocabulary_errors(films: DataFrame, words: DataFrame, sensations: DataFrame, moods: DataFrame) -> DataFrame:
    """(error): what is wrong with a vocabulary. films: mood; words: category, word (null: a category without words); sensations: sensation, category; moods: category, side (desired or avoid), tag (null: none)."""
    known = films.select(F.col("mood").alias("tag")).distinct()
    cats = words.select("category").distinct()
    parts = [
        films.groupBy("mood").count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("film_mood_vocab: duplicate moods").alias("error")),
        words.groupBy("category").agg(F.count("word").alias("n")).where("n = 0").select(F.concat(F.lit("user_mood_vocab: empty category "), "category").alias("error")),
        words.where(F.col("word") != F.lower("word")).select("category").distinct().select(F.concat(F.lit("user_mood_vocab: non-lowercase word in "), "category").alias("error")),
        sensations.join(cats, "category", "left_anti").select(F.concat(F.lit("user_mood_vocab: body sensation '"), "sensation", F.lit("' -> unknown category '"), "category", F.lit("'")).alias("error")),
        set_difference(cats, moods.select("category")).select(F.concat(F.lit("user_mood_map: categories mismatch ("), "side", F.lit(": "), "value", F.lit(")")).alias("error")),
        moods.where("tag is not null").join(known, "tag", "left_anti").select(F.concat(F.lit("user_mood_map: "), "category", F.lit("."), "side", F.lit(" tag '"), "tag", F.lit("' not in film enum")).alias("error")),
        moods.where("tag is not null").groupBy("category", "tag").agg(F.count_distinct("side").alias("n")).where("n > 1").groupBy("category").agg(F.array_sort(F.collect_set("tag")).alias("t")).select(F.concat(F.lit("user_mood_map: "), "category", F.lit(" has tags in both desired and avoid: "), F.array_join("t", ", ")).alias("error")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _later(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with `again`: whether an earlier line has the same key. The least line is an aggregate, so a frequent key is combined before the shuffle."""
    first = rows.groupBy(*key).agg(F.min("line").alias("__first"))
    return rows.join(first, key, "left").withColumn("again", F.coalesce(F.col("line") > F.col("__first"), F.lit(False))).drop("__first")


def rule_errors(lines: DataFrame, film_moods: tuple[str, ...] = rules.FILM_MOODS) -> DataFrame:
    """(line, errors) of bad lines of a rule file; lines: line, value."""
    keys = ("match_type", "pattern", "add")
    kinds = F.from_json("value", "struct<match_type:string,pattern:string,add:array<string>>")
    r = Line(F.col("value"))
    rows = lines.select("line", "value", r.is_object.alias("ok"), F.array_sort(r.keys).alias("keys"), kinds.alias("r"), r.kind("add").startswith("ARRAY").alias("is_list")).withColumns({"kind": F.col("r.match_type"), "pattern": F.col("r.pattern")})
    shaped = F.col("ok") & (F.col("keys") == F.array_sort(F.array(*[F.lit(k) for k in keys])))
    rows = rows.withColumn("shaped", F.coalesce(shaped, F.lit(False)))
    again = _later(rows.where("shaped"), ["kind", "pattern"]).select("line", "again")
    rows = rows.join(again, "line", "left")
    unknown = F.array_except("r.add", F.array(*[F.lit(m) for m in film_moods]))
    has_list = F.coalesce(F.col("is_list") & (F.size("r.add") > 0), F.lit(False))
    inner = [
        F.when(~F.coalesce(F.col("kind").isin("genre", "keyword"), F.lit(False)), F.concat(F.lit("bad match_type "), F.coalesce("kind", F.lit("null")))), F.when(F.coalesce((F.col("pattern") != F.lower("pattern")) | (F.trim("pattern") == ""), F.lit(True)), F.lit("pattern must be non-empty lowercase")),
        F.when(F.col("again"), F.lit("duplicate pattern")), F.when(~has_list, F.lit("add must be a non-empty list")), F.when(has_list & (F.size(unknown) > 0), F.concat(F.lit("tags not in film enum: "), F.array_join(unknown, ", "))),
    ]
    errors = F.when(F.trim("value") == "", F.array(F.lit("blank line"))).when(~F.col("ok"), F.array(F.lit("bad JSON"))).when(~F.col("shaped"), F.array(F.lit("keys must be exactly match_type/pattern/add"))).otherwise(F.array_compact(F.array(*inner)))
    return rows.select("line", errors.alias("errors")).where(F.size("errors") > 0)


def tag_errors(labels: DataFrame, film_moods: tuple[str, ...] = rules.FILM_MOODS) -> DataFrame:
    """(line, errors) of bad rows of a label table: line, movie_key, film_mood_tags, provenance."""
    rows = _later(labels.select("line", "movie_key", "film_mood_tags", "provenance"), ["movie_key"])
    tags = F.coalesce("film_mood_tags", F.array().cast("array<string>"))
    unknown = F.array_except(tags, F.array(*[F.lit(m) for m in film_moods]))
    errors = F.array_compact(
        F.array(
            F.when(~F.col("provenance").eqNullSafe("deterministic_rules"), F.lit("provenance must be deterministic_rules")), F.when(F.col("again"), F.lit("duplicate movie_key")), F.when(tags != F.array_sort(F.array_distinct(tags)), F.lit("tags must be sorted and unique")),
            F.when(F.size(unknown) > 0, F.concat(F.lit("tags not in film enum: "), F.array_join(unknown, ", "))),
        )
    )
    return rows.select("line", errors.alias("errors")).where(F.size("errors") > 0)
