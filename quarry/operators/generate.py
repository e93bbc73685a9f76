"""Seeded synthetic examples: templates, held-out exclusion, quota sampling, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.operators.intent import mood_fields, override_moods


def order_key(seed: str, text: Column) -> Column:
    """A shuffle that depends on seed and text only."""
    return F.md5(F.concat(F.lit(seed), text))


def unambiguous(vocab: DataFrame) -> DataFrame:
    """(word, category) of words that stand in one category only."""
    return vocab.groupBy("word").agg(F.count_distinct("category").alias("n"), F.min("category").alias("category")).where("n = 1").drop("n")


def templates(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Every word in every template (`{}` is its place). Both sides are fixed vocabularies."""
    return words.crossJoin(F.broadcast(forms)).withColumn("text", F.expr("replace(form, '{}', word)"))


def mood_pairs(moods: DataFrame) -> DataFrame:
    """Ordered pairs of different moods."""
    a, b = moods.select(F.col("mood").alias("want")), moods.select(F.col("mood").alias("avoid"))
    return a.crossJoin(F.broadcast(b)).where("want <> avoid")


def chosen(forms: list[str], number: Column) -> Column:
    """The template of this number, in turn."""
    return F.element_at(F.array(*[F.lit(f) for f in forms]), (number % len(forms) + 1).cast("int"))


def fill(form: Column, **parts: Column) -> Column:
    """The template with {name} places filled."""
    for name, value in parts.items():
        form = F.replace(form, F.lit("{" + name + "}"), value)
    return form


def word_pairs(words: DataFrame, forms: list[str]) -> DataFrame:
    """(category, w1, w2, text): every two words of a category, in their order, in every template. words: category, n, word."""
    a, b = words.select("category", F.col("n").alias("n1"), F.col("word").alias("w1")), words.select("category", F.col("n").alias("n2"), F.col("word").alias("w2"))
    pairs = a.join(b, "category").where("n1 < n2")
    return pairs.select("category", "w1", "w2", F.explode(F.array(*[F.lit(f) for f in forms])).alias("form")).select("category", "w1", "w2", fill(F.col("form"), w1=F.col("w1"), w2=F.col("w2")).alias("text"))


def category_pairs(words: DataFrame, form: str, first: int = 3) -> DataFrame:
    """(c1, c2, text, desired, avoid): the first words of every two categories, in order of name. words: category, n (from 0), word: a fixed vocabulary."""
    own = words.where(F.col("n") < first)
    a, b = own.select(F.col("category").alias("c1"), F.col("word").alias("w1")), own.select(F.col("category").alias("c2"), F.col("word").alias("w2"))
    both = a.join(F.broadcast(b), F.col("c1") < F.col("c2")).withColumn("m", mood_fields(F.array("c1", "c2")))
    return both.select("c1", "c2", fill(F.lit(form), w1=F.col("w1"), w2=F.col("w2")).alias("text"), "m.desired", "m.avoid")


def word_moods(words: DataFrame, moods: DataFrame, forms: list[str], first: int = 8) -> DataFrame:
    """(category, text, desired, avoid): the first words of each category with every mood; the template goes by the lengths of both. The mood is desired beside the category's, and never avoided."""
    own = words.where(F.col("n") < first).crossJoin(F.broadcast(moods.select("mood"))).withColumn("m", mood_fields(F.array("category")))
    moved = override_moods(F.col("m.desired"), F.col("m.avoid"), F.array("mood"), F.array().cast("array<string>"))
    text = fill(chosen(forms, F.length("word") + F.length("mood")), w=F.col("word"), am=article(F.col("mood")), m=F.col("mood"))
    return own.select("category", text.alias("text"), moved["desired"].alias("desired"), moved["avoid"].alias("avoid"))


def wishes(words: DataFrame, moods: DataFrame, forms: list[str], first: int = 4) -> DataFrame:
    """(category, text, desired, avoid): the first words of each category with every third mood wanted and every fourth, from the second, not wanted; what is said beats the category's moods both ways. moods: i (from 0, in order of name), mood."""
    want = moods.where("i % 3 = 0").select(F.col("mood").alias("want"))
    less = moods.where("i % 4 = 1").select(F.col("mood").alias("less"))
    both = F.broadcast(want.crossJoin(less).where("want <> less"))
    own = words.where(F.col("n") < first).crossJoin(both).withColumn("m", mood_fields(F.array("category")))
    said = override_moods(F.col("m.desired"), F.col("m.avoid"), F.array("want"), F.array("less"))
    text = fill(chosen(forms, F.length("word") + F.length("less")), w=F.col("word"), m=F.col("want"), a=F.col("less"))
    return own.select("category", text.alias("text"), said["desired"].alias("desired"), said["avoid"].alias("avoid"))


def neighbours(topics: DataFrame, forms: list[str], reach: int = 8) -> DataFrame:
    """(g1, g2, text): every topic with the next `reach` ones, templates in turn by both numbers. topics: i (from 0), shown, gold. An equi-join on the numbers in reach."""
    a = topics.select(F.col("i"), F.col("shown").alias("d1"), F.col("gold").alias("g1"), F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("j")).withColumn("k", F.col("i") + F.col("j") + 1)
    b = topics.select(F.col("i").alias("k"), F.col("shown").alias("d2"), F.col("gold").alias("g2"))
    return a.join(b, "k").select("g1", "g2", fill(chosen(forms, F.col("i") + F.col("j")), a=F.col("d1"), b=F.col("d2")).alias("text"))


def compounds(places: DataFrame, form: str, about: str) -> DataFrame:
    """(plot, genre, text): `a place genre`, and the same about each of its objects. places: place, word, genre, objects (shown, gold)."""
    head = article(F.concat_ws(" ", "place", "word"))
    plain = places.select(F.array("place").alias("plot"), "genre", fill(F.lit(form), head=head).alias("text"))
    more = places.select("place", "genre", head.alias("head"), F.explode("objects").alias("o"))
    return plain.unionByName(more.select(F.array("place", "o.gold").alias("plot"), "genre", fill(F.lit(about), head=F.col("head"), o=F.col("o.shown")).alias("text")))


def implied(phrases: DataFrame, forms: DataFrame) -> DataFrame:
    """(concept, text, leaks): every phrase of a concept in the templates of its kind, and whether the text names the concept or one of its longer words. phrases: concept, kind, phrase; forms: kind, form."""
    out = phrases.join(F.broadcast(forms), "kind").select("concept", fill(F.col("form"), ph=F.col("phrase")).alias("text"))
    low = F.lower("text")
    parts = F.filter(F.split(F.translate("concept", "-", " "), " "), lambda w: F.length(w) > 2)
    leak = F.contains(low, F.lower("concept")) | F.arrays_overlap(F.split(F.translate(low, "-", " "), " "), parts)
    return out.withColumn("leaks", leak)


def mood_queries(vocab: DataFrame, moods: DataFrame, plots: DataFrame, pairs: int = 14) -> DataFrame:
    """(qid, query, mode, categories, desired, avoid): for each category a query of its first two words and desired moods and one of its first word and a plot; for the first `pairs` neighbours one of both first words.

    vocab: category, n (order in the category), word; moods: category, desired; plots: i (from 0, by category order), plot. The tables are fixed vocabularies.
    """
    words = vocab.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("w"))
    c = words.join(moods, "category").withColumn("i", F.row_number().over(Window.orderBy("category")) - 1)
    two = lambda a: F.array_join(F.slice(a, 1, 2), " and ")
    single = c.select(F.concat(F.lit("feeling "), two(F.col("w")), F.lit(", want something "), two(F.col("desired"))).alias("query"), F.lit("mood").alias("mode"), F.array("category").alias("categories"))
    hybrid = c.join(F.broadcast(plots), "i").select(F.concat(F.lit("feeling "), F.get("w", F.lit(0)), F.lit(", in the mood for "), "plot").alias("query"), F.lit("hybrid").alias("mode"), F.array("category").alias("categories"))
    n = c.select((F.col("i") - 1).alias("i"), F.get("w", F.lit(0)).alias("next"), F.col("category").alias("other"))
    both = c.where(F.col("i") < pairs).join(n, "i").select(F.concat(F.lit("feeling "), F.get("w", F.lit(0)), F.lit(" but also "), "next").alias("query"), F.lit("mood").alias("mode"), F.array("category", "other").alias("categories"))
    every = None
    for part, rows in enumerate((single, hybrid, both)):
        rows = rows.withColumn("part", F.lit(part))
        every = rows if every is None else every.unionByName(rows)
    number = F.row_number().over(Window.orderBy("part", F.get("categories", F.lit(0))))
    out = every.withColumn("qid", F.format_string("mq%02d", number)).withColumn("m", mood_fields(F.col("categories")))
    return out.select("qid", "query", "mode", "categories", F.col("m.desired").alias("desired"), F.col("m.avoid").alias("avoid"))


def article(word: Column) -> Column:
    """The word with a or an."""
    return F.concat(F.when(F.lower(word).rlike("^[aeiou]"), "an ").otherwise("a "), word)


def body_sentences(words: DataFrame, places: dict[str, list[str]], forms: dict[str, str]) -> DataFrame:
    """(category, word, text): a word in the sentence of each place that takes it. places: place -> its words ('*' prefix in the key: all words but these); words that name their category or a film mood are left out."""
    ok = ~F.contains(F.translate(F.lower("category"), "_-", "  "), F.lower("word")) & ~F.lower("word").isin(*rules.FILM_MOODS)
    sentences = []
    for place, own in places.items():
        takes = F.col("word").isin(*own) if own else F.lit(False)
        takes = ~takes if place.startswith("*") else takes
        sentences.append(F.when(takes, F.replace(F.replace(F.lit(forms[place]), F.lit("{an}"), article(F.col("word"))), F.lit("{}"), F.col("word"))))
    return words.where(ok).select("category", "word", F.explode(F.array_compact(F.array(*sentences))).alias("text"))


def leaks(text: Column, terms: Column) -> Column:
    """The terms that stand in the text as whole phrases."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    return F.filter(terms, lambda t: F.contains(low, F.concat(F.lit(" "), F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "), F.lit(" "))))


def held_out(df: DataFrame, held: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text, trimmed and lower-cased, isn't held out."""
    norm = lambda c: F.lower(F.trim(c))
    return df.join(held.select(norm(F.col(text)).alias("__h")).distinct(), norm(F.col(text)) == F.col("__h"), "left_anti")


def quota(df: DataFrame, bucket: str, per_bucket: int, seed: str, text: str = "text", priority: str | None = None) -> DataFrame:
    """per_bucket rows of each bucket in seeded order. Texts that repeat (trimmed, lower-cased) are kept once, in the bucket of least priority number: an aggregate, whose rows are combined before the shuffle. The quota is the operator's purpose."""
    key = F.lower(F.trim(F.col(text)))
    order = F.struct(F.col(priority) if priority else F.col(bucket), order_key(seed, F.col(text)).alias("o"), F.col(text).alias("t"))
    one = df.groupBy(F.md5(key).alias("__h")).agg(F.min_by(F.struct(*df.columns), order).alias("__v")).select("__v.*").withColumn("__k", key)
    w = Window.partitionBy(bucket).orderBy(order_key(seed, F.col(text)), "__k")
    return one.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_bucket).drop("__k")


def split(n: Column) -> Column:
    """18 of 20 train, then val, then test, by running number from 1."""
    return F.when((n - 1) % 20 == 18, "val").when((n - 1) % 20 == 19, "test").otherwise("train")


def invariants(df: DataFrame, moods: str, most: int = 3, vocab=rules.FILM_MOODS) -> DataFrame:
    """(check, violations): moods outside the vocabulary, too many moods, empty texts. Columns `feeling` and `want`, where df has them, are checked for film moods in the feeling and feelings in the want (`user_words`, `genres` and `plot`: see separation())."""
    known = F.array(*[F.lit(v) for v in vocab])
    checks = {"unknown_mood": F.size(F.array_except(moods, known)) > 0, "too_many_moods": F.size(moods) > most, "empty_text": F.trim("text") == ""}
    row = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("x")).select("x.*")


def slice_shares(df: DataFrame, group: str, flag: Column, least: dict[str, float]) -> DataFrame:
    """(group, share, ok) against least shares."""
    need = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col(group)), F.lit(0.0)) if least else F.lit(0.0)
    return df.groupBy(group).agg(F.round(F.avg(F.when(flag, 1.0).otherwise(0.0)), 6).alias("share")).withColumn("ok", F.col("share") >= need)


def separation(df: DataFrame, feeling: str, want: str, user_words: tuple[str, ...], film_moods=rules.FILM_MOODS) -> DataFrame:
    """df with `mixed`: the film moods that stand in the feeling's text and the feelings that stand in the want's."""
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return df.withColumn("mixed", F.concat(leaks(F.col(feeling), strings(film_moods)), leaks(F.col(want), strings(user_words))))


def outside(df: DataFrame, fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """(field, value, n): values of array columns that aren't in the field's fixed vocabulary."""
    parts = [df.select(F.lit(n).alias("field"), F.explode(F.array_except(n, F.array(*[F.lit(v) for v in vocab]))).alias("value")) for n, vocab in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("field", "value").agg(F.count("*").alias("n"))
