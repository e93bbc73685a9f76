"""Text to structured intent: filters, eras, genres, moods, query building, validation. Column expressions; the greedy cover folds over few categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.text import collapse, fold, stem

_Y = r"((?:19|20)[0-9][0-9])"


def _num(c: Column) -> Column:
    return c.try_cast("int")


def _get(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_filters(query: Column) -> Column:
    """struct(year_min, year_max, min_rating): ranges, after, before (inclusive); decades override; `80s` counts anywhere in the text."""
    q = F.lower(F.coalesce(query, F.lit("")))
    between = r"(?:from|between)\s*([0-9]{4})\s*(?:to|and|-)\s*([0-9]{4})"
    a, b = _num(_get(q, between)), _num(_get(q, between, 2))
    ranged = a.isNotNull()
    after = _num(_get(q, r"(?:after|since|from|newer than)\s*([0-9]{4})"))
    before = _num(_get(q, r"(?:before|until|older than)\s*([0-9]{4})"))
    lo = F.when(ranged, F.least(a, b)).otherwise(after)
    hi = F.coalesce(before, F.when(ranged, F.greatest(a, b)))
    decade = _num(_get(q, r"\b(19[2-9]0|20[0-2]0)s\b"))
    short = F.when(q.contains("80s"), 1980).when(q.contains("90s"), 1990).when(q.contains("2000s"), 2000)
    start = F.coalesce(short, decade)
    best = q.rlike("highly rated|top rated|critically acclaimed|best")
    return F.struct(F.coalesce(start, lo).alias("year_min"), F.coalesce(start + 9, hi).alias("year_max"), F.when(best, 7.5).alias("min_rating"))


def parse_era(text: Column) -> Column:
    """struct(min_year, max_year): range, then decade, then short decade, then before (exclusive) and after."""
    t = F.lower(F.coalesce(text, F.lit("")))
    span = rf"\b{_Y}\s*(?:-|to|through)\s*{_Y}\b"
    a, b = _num(_get(t, span)), _num(_get(t, span, 2))
    decade = _num(_get(t, r"\b(?:the\s+)?((?:19|20)[0-9]0)s\b"))
    tens = _num(_get(t, r"\b(?:the\s+)?([0-9]0)s\b"))
    start = F.coalesce(decade, F.when(tens >= 30, 1900 + tens).otherwise(2000 + tens))
    before, after = _num(_get(t, rf"\bbefore\s+{_Y}\b")), _num(_get(t, rf"\b(?:after|since|from)\s+{_Y}\b"))
    return F.struct(F.when(a.isNotNull(), a).when(start.isNotNull(), start).otherwise(after).alias("min_year"), F.when(a.isNotNull(), b).when(start.isNotNull(), start + 9).otherwise(before - 1).alias("max_year"))


def parse_rating(text: Column) -> Column:
    return _get(F.lower(F.coalesce(text, F.lit(""))), r"\brat(?:ed|ing)\s+(?:above|over|at least)\s+([0-9](?:\.[0-9])?)\b").try_cast("double")


def parse_genres(text: Column) -> Column:
    """Genres named in the text: synonyms first, then the list's order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    named = [*rules.GENRE_SYNONYMS, *((g.lower(), g) for g in rules.GENRES)]
    return F.array_distinct(F.array_compact(F.array(*[F.when(t.rlike(rf"\b{w}\b"), F.lit(g)) for w, g in named])))


def mood_fields(categories: Column) -> Column:
    """struct(desired, avoid): sorted film moods of the categories; a desired mood is never avoided."""
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    table = lambda i: F.create_map(*[x for k, v in rules.MOOD_MAP.items() for x in (F.lit(k), strings(v[i]))])
    gather = lambda i: F.array_distinct(F.flatten(F.transform(F.coalesce(categories, strings([])), lambda c: F.coalesce(F.element_at(table(i), c), strings([])))))
    desired = gather(0)
    return F.struct(F.array_sort(desired).alias("desired"), F.array_sort(F.array_except(gather(1), desired)).alias("avoid"))


def override_moods(desired: Column, avoid: Column, more: Column, less: Column) -> Column:
    """Explicit wishes beat the map both ways: (desired + more) - less, (avoid + less) - those."""
    want = F.array_except(F.array_union(desired, more), less)
    return F.struct(F.array_sort(want).alias("desired"), F.array_sort(F.array_except(F.array_union(avoid, less), want)).alias("avoid"))


def cover(word_categories: Column) -> Column:
    """Greedy set cover over array<struct<word, categories>>: the category of most uncovered words, the first by name among equals, until all words are covered."""
    state = F.struct(F.array().cast("array<string>").alias("picked"), word_categories.alias("left"))

    def step(s: Column, _: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.flatten(F.transform(s["left"], lambda w: w["categories"]))))
        counted = F.transform(names, lambda n: F.struct(F.negative(F.size(F.filter(s["left"], lambda w: F.array_contains(w["categories"], n)))).alias("n"), n.alias("name")))
        best = F.array_min(counted)["name"]
        rest = F.filter(s["left"], lambda w: ~F.array_contains(w["categories"], best))
        return F.when(F.size(s["left"]) == 0, s).otherwise(F.struct(F.array_append(s["picked"], best).alias("picked"), rest.alias("left")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(rules.MOOD_MAP))), state, step, lambda s: s["picked"])


def lexicon(vocab: DataFrame) -> DataFrame:
    """(word, categories) of a feelings vocabulary (category, word): its words, the parts of the categories' names, and two fixed forms."""
    parts = vocab.select("category").distinct().select("category", F.explode(F.split("category", "_")).alias("word"))
    fixed = vocab.sparkSession.createDataFrame([("guilt", "guilty"), ("aliveness_joy", "joyful")], "category string, word string")
    both = vocab.select("category", F.lower("word").alias("word")).union(parts).union(fixed).distinct()
    return both.groupBy("word").agg(F.array_sort(F.collect_list("category")).alias("categories"))


def parse_tier1(texts: DataFrame, words: DataFrame, text: str = "text", mode: str = "mode", nouns: tuple[str, ...] = ()) -> DataFrame:
    """texts with `intent`: mode, moods, genres, era, rating, confidence. words: a lexicon(); it is of fixed, small size and travels as one literal map. nouns: the words for an item of the catalog, singular and plural, which say nothing about it; they come with the caller's vocabulary."""
    book = {r["word"]: r["categories"] for r in words.collect()}  # a vocabulary of a few hundred words
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    feeling = F.regexp_replace(low, rf"(?s){rules.DESIRE}.*$", "")
    feels = (F.coalesce(F.col(mode), F.lit("")) == "mood") | low.rlike(rules.FEELING)
    phrases = sorted((w for w in book if " " in w), key=lambda w: (-len(w), w))
    single = [w for w in book if " " not in w]
    remaining, found = feeling, []
    for p in phrases:
        found.append(F.when(remaining.rlike(rf"\b{p}\b"), F.struct(F.lit(p).alias("word"), strings(book[p]).alias("categories"))))
        remaining = F.when(remaining.rlike(rf"\b{p}\b"), F.replace(remaining, F.lit(p), F.lit(" "))).otherwise(remaining)
    table = F.create_map(*[x for w in single for x in (F.lit(w), strings(book[w]))])
    toks = F.array_distinct(F.filter(F.regexp_extract_all(remaining, F.lit("[a-z][a-z'-]*"), F.lit(0)), lambda t: F.array_contains(F.map_keys(table), t)))
    matched = F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<word:string,categories:array<string>>>"), F.transform(toks, lambda t: F.struct(t.alias("word"), F.element_at(table, t).alias("categories"))))
    out = texts.withColumn("__m", F.when(feels, matched).otherwise(F.array().cast("array<struct<word:string,categories:array<string>>>")))
    out = out.withColumn("__c", cover(F.col("__m")))
    consumed = F.flatten(F.transform("__m", lambda m: F.split(m["word"], " ")))
    left = F.filter(F.regexp_extract_all(low, F.lit("[a-z][a-z'-]*"), F.lit(0)), lambda t: ~t.isin(*rules.INTENT_STOPWORDS, *nouns) & ~F.array_contains(consumed, t) & ~t.isin(*rules.FILM_MOODS))
    asked = F.col(mode)
    has = F.size("__c") > 0
    resolved = F.when(asked.isin("category", "random"), asked).when(has & (F.size(left) >= 3), "hybrid").when(has, "mood").when(asked.isin("mood", "content", "hybrid"), asked).otherwise("content")
    genres, moods = parse_genres(F.col(text)), mood_fields(F.col("__c"))
    intent = F.struct(
        resolved.alias("mode"), F.col("__c").alias("user_moods"), moods["desired"].alias("desired_film_moods"), moods["avoid"].alias("avoid_film_moods"), strings([]).alias("plot_elements"), genres.alias("genres_include"), strings([]).alias("genres_exclude"),
        parse_era(F.col(text)).alias("era"), F.struct(F.lit(0.0).alias("darkness"), F.lit(0.0).alias("intensity")).alias("tone"), F.struct(parse_rating(F.col(text)).alias("min_rating")).alias("constraints"),
        F.coalesce(F.col(text), F.lit("")).alias("free_text_query"), F.when(has | (F.size(genres) > 0), 0.9).otherwise(0.3).alias("confidence"),
    )
    return out.withColumn("intent", intent).drop("__m", "__c")


def intent_query(intent: Column) -> Column:
    """struct(query_text, filters, boosts): the plot elements that aren't blank instead of the free text where there are any; mood mode appends the desired moods."""
    plot = F.filter(F.transform(intent["plot_elements"], lambda x: F.trim(x)), lambda x: x != "")
    base = F.when(F.size(plot) > 0, F.array_join(plot, " ")).otherwise(F.trim(F.coalesce(intent["free_text_query"], F.lit(""))))
    wished = F.when((intent["mode"] == "mood") & (F.size(intent["desired_film_moods"]) > 0), F.concat(base, F.lit(" "), F.array_join(intent["desired_film_moods"], " "))).otherwise(base)
    filters = F.struct(intent["era"]["min_year"].alias("min_year"), intent["era"]["max_year"].alias("max_year"), intent["constraints"]["min_rating"].alias("min_rating"), intent["genres_include"].alias("genres_include"), intent["genres_exclude"].alias("genres_exclude"))
    boosts = F.struct(intent["desired_film_moods"].alias("desired_film_moods"), intent["avoid_film_moods"].alias("avoid_film_moods"), intent["tone"].alias("tone"))
    return F.struct(F.trim(wished).alias("query_text"), filters.alias("filters"), boosts.alias("boosts"))


def expand_query(query: Column) -> Column:
    """The collapsed query with the texts of all expansions whose word groups it touches."""
    toks = F.transform(F.regexp_extract_all(fold(query), F.lit("[a-z0-9]+"), F.lit(0)), stem)

    def touches(group) -> Column:
        return F.arrays_overlap(toks, F.array(*[stem(F.lit(w)) for w in sorted(group)]))

    extras = []
    for groups, text in rules.EXPANSIONS:
        cond = F.lit(True)
        for g in groups:
            cond &= touches(g)
        extras.append(F.when(cond, F.lit(text)))
    return F.concat_ws(" ", collapse(query), *extras)


def _alias(words) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(w.replace("-", r"\-").replace(" ", r"\s+") for w in sorted(words, key=lambda w: -len(w))) + ")(?![a-z0-9])"


def _first_term(text: Column, terms: dict) -> Column:
    """Of the terms in the text the one that comes first, by name among equals."""
    found = F.array_compact(F.array(*[F.when(text.rlike(_alias(a)), F.struct(F.regexp_instr(text, F.lit(_alias(a))).alias("at"), F.lit(n).alias("name"))) for n, a in terms.items()]))
    return F.array_min(found)["name"]


def mood_intent(df: DataFrame, query: str, out: str = "mood") -> DataFrame:
    """df with a struct of the mood reading of a query column: emotion, tones, direction, energy, safety, cleaned query.

    The reading goes by steps, each a projection over the last, so that no text is searched twice for the same thing.
    """
    marker = r"(?s)^(.*?\b(?:i\s+want|i\s+need|want|need|looking\s+for|give\s+me)\s+)"
    film = r"(?s)^(.*?)\b(?:something|a\s+movie\s+that|a\s+movie\s+with|a\s+film\s+that|a\s+film\s+with)\b"
    state = r"\b(?:after\s+work\s+i\s+feel|i\s+feel|i\s+am\s+feeling|i'm\s+feeling|im\s+feeling|feeling)\b(.*)$"
    be = r"\b(?:i\s+am|i'm|im)\s+(.+)"
    context = r"(?:[ ,.;:\-]*(?:(?:from|after|at)\s+[a-z0-9]+|today|tonight|now|right\s+now|this\s+(?:morning|afternoon|evening|week|month)|and)(?=\s|$))*[ ,.;:\-]*$"
    strip = lambda c: F.regexp_replace(c, r"^[ ,.;:\-]+|[ ,.;:\-]+$", "")
    c = F.col
    words = "|".join(_alias(a) for a in rules.EMOTIONS.values())
    d = df.withColumn("__norm", collapse(c(query))).withColumn("__low", fold(c("__norm")))
    d = d.withColumns({"__a": F.length(F.regexp_extract("__low", marker, 1)), "__film": F.when(c("__low").rlike(film), F.length(F.regexp_extract("__low", film, 1)))})
    d = d.withColumn("__start", F.when(c("__a") > 0, c("__a")).otherwise(c("__film")))
    d = d.withColumns({"__before": F.when(c("__start").isNotNull(), c("__low").substr(F.lit(1), c("__start"))).otherwise(c("__low")), "__wish": F.when(c("__start").isNotNull(), c("__low").substr(c("__start") + 1, F.length("__low"))).otherwise(c("__low")), "__moody": c("__low").rlike(words)})
    d = d.withColumns({"__phrase": _get(c("__low"), r"\bi\s+am\s+in\s+a\s+(.+?)\s+mood\b"), "__state": _get(c("__before"), state), "__be": _get(c("__before"), be), "__led": F.regexp_replace(c("__before"), r"\b(?:i\s+want|i\s+need|want|need|looking\s+for|give\s+me)\s*$", "")})
    d = d.withColumn("__led", F.regexp_replace(strip(F.regexp_replace(strip(c("__led")), r"\band\s*$", "")), rf"^(?:(?:{'|'.join(rules.INTENSIFIERS)})\b\s*)+", ""))
    adjective = F.coalesce(*[F.when(c("__led").rlike("^" + _alias(a) + context), F.lit(n)) for n, a in rules.EMOTIONS.items()])
    emotion = F.coalesce(_first_term(c("__phrase"), rules.EMOTIONS), _first_term(c("__state"), rules.EMOTIONS), F.when(c("__be").isNotNull(), _first_term(c("__be"), rules.EMOTIONS)).when(c("__start").isNotNull(), adjective))
    found = F.array_sort(F.array_compact(F.array(*[F.when(c("__wish").rlike(_alias(a)), F.struct(F.regexp_instr("__wish", F.lit(_alias(a))).alias("at"), F.lit(n).alias("name"))) for n, a in rules.TONES.items()])))
    d = d.withColumns({"__emotion": F.when(c("__moody"), emotion), "__tones": F.transform(found, lambda t: t["name"])})
    has = lambda *names: F.arrays_overlap("__tones", F.array(*[F.lit(n) for n in names]))
    direction = None
    for pattern, name in rules.DIRECTIONS:
        direction = F.when(c("__low").rlike(pattern), name) if direction is None else direction.when(c("__low").rlike(pattern), name)
    energy = F.when(has("cozy", "light", "warm"), "light_cozy").when(has("gentle") | c("__low").rlike(r"\b(drift\s+off|slow)\b"), "slow_gentle").when(has("funny"), "funny_energetic").when(has("hopeful") | c("__low").rlike(r"\b(emotional|hope|survive)\b"), "emotional_but_safe")
    d = d.withColumns({"__direction": direction.when(has("cozy", "gentle"), "calm_me_down"), "__energy": energy, "__dark": has(*rules.DARK_TONES), "__sad": c("__emotion").isNotNull(), "__clean": F.when(c("__start").isNotNull(), strip(c("__norm").substr(c("__start") + 1, F.length("__norm")))).otherwise(c("__norm"))})
    keep = ((c("__emotion") == "lonely") & (c("__direction") == "comfort_me")) | ((c("__emotion") == "stressed") & (c("__direction") == "calm_me_down"))
    said = F.when(c("__emotion") == "lonely", fold(c("__clean")).rlike(_alias(("lonely",)))).otherwise(fold(c("__clean")).rlike(_alias(("stressed",))))
    safety = F.when(c("__sad") & c("__dark"), "neutral").when(c("__dark"), "dark_intended").when(c("__sad"), "safe_hopeful").otherwise("neutral")
    reading = F.struct(
        c("__emotion").alias("current_emotion"), F.when(c("__sad"), "free_text").otherwise("none").alias("emotion_source"), c("__direction").alias("desired_direction"), c("__tones").alias("desired_movie_tone"), c("__energy").alias("energy_level"),
        safety.alias("safety_sensitivity"), F.when(c("__dark"), True).when(c("__sad"), False).alias("allow_dark_content"), F.when(F.coalesce(keep & ~said, F.lit(False)), F.concat("__emotion", F.lit(" - "), "__clean")).otherwise(c("__clean")).alias("cleaned_query"),
    )
    return d.withColumn(out, reading).select(*df.columns, out)


def intent_errors(intent: Column) -> Column:
    """Messages of an intent that breaks the schema; empty if it is valid."""
    checks = {
        "mode": ~intent["mode"].isin("mood", "content", "hybrid", "category", "random"),
        "darkness": ~intent["tone"]["darkness"].between(-1, 1), "intensity": ~intent["tone"]["intensity"].between(0, 1), "confidence": ~intent["confidence"].between(0, 1),
        "free_text_query": intent["free_text_query"].isNull(),
    }
    for name in ("user_moods", "desired_film_moods", "avoid_film_moods", "plot_elements", "genres_include", "genres_exclude"):
        checks[name] = intent[name].isNull()
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(m)) for m, bad in checks.items()]))


def merge_extracted(df: DataFrame, reply: str, intent: str = "intent", most: int = 8) -> DataFrame:
    """df whose intent takes the story fields of a model's JSON reply: plot elements (trimmed, no blanks, `most` at most), genres asked for behind those already found, genres ruled out; genres outside the list are left out. A reply that isn't such an object, or makes the intent invalid, changes nothing.

    reply: column with {"plot_elements": [..], "genres_include": [..], "genres_exclude": [..]}; absent lists are empty.
    """
    value, i = F.try_parse_json(F.col(reply)), F.col(intent)
    strings = F.array().cast("array<string>")
    kind = lambda n: F.schema_of_variant(F.try_variant_get(value, f"$.{n}", "variant"))
    given = lambda n: F.coalesce(F.try_variant_get(value, f"$.{n}", "array<string>"), strings)
    names = ("plot_elements", "genres_include", "genres_exclude")
    usable = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    for n in names:
        usable &= kind(n).isNull() | kind(n).startswith("ARRAY")
    known = F.array(*[F.lit(g) for g in rules.GENRES])
    plot = F.slice(F.filter(F.transform(given("plot_elements"), lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    genres = lambda n: F.filter(given(n), lambda g: F.array_contains(known, g))
    candidate = i.withField("plot_elements", plot).withField("genres_include", F.array_union(i["genres_include"], genres("genres_include"))).withField("genres_exclude", genres("genres_exclude"))
    out = df.withColumn("__c", F.when(usable, candidate))
    return out.withColumn(intent, F.when(F.col("__c").isNotNull() & (F.size(intent_errors(F.col("__c"))) == 0), F.col("__c")).otherwise(i)).drop("__c")
