"""Labels: rule tagging, gold over silver, audits, agreement, regrade checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed value: provenance of a label that no person has changed
SILVER = "silver_llm_pregrade"


def rule_tags(catalog: DataFrame, rules: DataFrame, id_: str, genres: Column, text: Column, few: int = 64, most: int = 1_000_000) -> DataFrame:
    """(id, tags) for every row: sorted distinct tags of all rules that fit. rules: match_type ('genre': one of the row's genres, 'keyword': contained in its text), pattern, add. Rules without a pattern fit nothing; an empty keyword fits every text.

    Up to `few` rules travel as one literal array and are tested in the row. More go into an automaton with failure links, which finds all patterns in one pass over a text, however many they are; one automaton holds `most` rules, further ones follow in the same tasks.
    """
    rules = rules.where("pattern is not null").select("match_type", "pattern", F.coalesce("add", F.array().cast("array<string>")).alias("add"))
    head = rules.limit(few + 1).collect()
    own = catalog.select(id_, F.transform(genres, lambda g: F.lower(F.trim(g))).alias("__g"), F.lower(F.coalesce(text, F.lit(""))).alias("__t"))
    if len(head) <= few:
        strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
        table = lambda kind: F.array(*[F.struct(F.lit(r["pattern"]).alias("pattern"), strings(r["add"]).alias("add")) for r in head if r["match_type"] == kind]).cast("array<struct<pattern:string,add:array<string>>>")
        hits = F.concat(F.filter(table("genre"), lambda r: F.coalesce(F.array_contains(F.col("__g"), r["pattern"]), F.lit(False))), F.filter(table("keyword"), lambda r: F.contains(F.col("__t"), r["pattern"])))
        return own.select(id_, F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda r: r["add"])))).alias("tags"))
    out, held = own.withColumn("tags", F.array().cast("array<string>")), []
    for r in rules.toLocalIterator():
        held.append((r["match_type"], r["pattern"], r["add"]))
        if len(held) == most:
            out, held = _searched(out, held), []
    if held:
        out = _searched(out, held)
    return out.select(id_, "tags")


def _searched(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    """rows whose tags are joined by those of these rules; rows: __g, __t, tags and any others."""
    shared, place = rows.sparkSession.sparkContext.broadcast(rules), rows.columns.index("tags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        by_word, by_genre, always = {}, {}, set()
        for kind, pattern, add in shared.value:
            if kind == "keyword" and not pattern:
                always.update(add)
            elif kind in ("keyword", "genre"):
                (by_word if kind == "keyword" else by_genre).setdefault(pattern, set()).update(add)
        automaton = ahocorasick.Automaton()
        for pattern, add in by_word.items():
            automaton.add_word(pattern, (pattern, add))
        if by_word:
            automaton.make_automaton()
        for b in batches:
            tags = []
            for genres, text, before in zip(b["__g"].to_pylist(), b["__t"].to_pylist(), b["tags"].to_pylist()):
                found = {p: add for _, (p, add) in automaton.iter(text)} if by_word else {}
                tags.append(sorted(always.union(before, *found.values(), *(by_genre.get(g, ()) for g in genres or ()))))
            yield b.set_column(place, "tags", pa.array(tags, pa.list_(pa.string())))

    return rows.mapInArrow(run, rows.schema)


def gold_over_silver(silver: DataFrame, gold: DataFrame, keys=("qid", "id")) -> DataFrame:
    """Merged labels with their source: gold's grade where there is one, gold-only rows added; silver rows that repeat stay.

    gold may have `provenance` and `notes`, which are kept; without a provenance it is told by how the grades compare. Silver rows have the provenance SILVER.
    """
    told = [F.col(n) if n in gold.columns else F.lit(None).cast("string").alias(n) for n in ("provenance", "notes")]
    g = gold.select(*keys, F.col("grade").alias("gold_grade"), *told, F.lit(True).alias("g"))
    s = silver.select(*keys, F.col("grade").alias("silver_grade"), F.lit(True).alias("s"))
    both = s.join(g, list(keys), "left")
    only = g.join(s.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit(None).cast("int").alias("silver_grade"), F.lit(None).cast("boolean").alias("s"), "gold_grade", "provenance", "notes", "g")
    out = both.unionByName(only)
    won = F.coalesce(F.col("g"), F.lit(False))
    compared = F.when(F.col("s").isNull(), "gold_only").when(F.col("gold_grade").eqNullSafe(F.col("silver_grade")), "gold_agrees").otherwise("gold_overrides")
    return out.select(
        *keys, F.when(won, F.col("gold_grade")).otherwise(F.col("silver_grade")).alias("grade"), F.when(won, "gold").otherwise("silver").alias("label_source"),
        F.when(won, F.coalesce("provenance", compared)).otherwise(SILVER).alias("label_provenance"), "silver_grade", "gold_grade", F.col("notes").alias("gold_notes"),
    )


def merge_errors(merged: DataFrame, allowed: tuple[str, ...], keys=("qid", "id")) -> DataFrame:
    """(keys, errors) of merged labels that break an invariant: the grade is that of its source, gold rows have a gold grade and an allowed provenance, silver rows have neither."""
    c, gold, silver = F.col, F.col("label_source").eqNullSafe("gold"), F.col("label_source").eqNullSafe("silver")
    return errors(
        merged,
        {
            "invalid label_source": ~gold & ~silver, "invalid gold invariant": gold & (c("gold_grade").isNull() | ~c("grade").eqNullSafe(c("gold_grade"))), "invalid gold provenance": gold & ~F.coalesce(c("label_provenance").isin(*allowed), F.lit(False)),
            "invalid silver invariant": silver & (c("gold_grade").isNotNull() | ~c("grade").eqNullSafe(c("silver_grade"))), "invalid silver provenance": silver & ~c("label_provenance").eqNullSafe(SILVER),
        },
    ).where(F.size("errors") > 0).select(*keys, "errors")


def gold_only(silver: DataFrame, gold: DataFrame, keys=("qid", "id")) -> DataFrame:
    return gold.join(silver, list(keys), "left_anti")


def missing_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of left without a row in right, for checks that must find none."""
    return left.select(*keys).distinct().join(right, keys, "left_anti")


def assert_empty(df: DataFrame, what: str) -> None:
    """ValueError with the first rows if there are any."""
    rows = df.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {', '.join(str(r.asDict()) for r in rows)}")


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: rows, filled, complete, exact and within_1 agreement, rows that differ by 1 and by 2 at least; pairs: silver, gold. A missing silver grade counts as -1; until all gold grades are there the shares are null and the counts 0."""
    s, g = F.coalesce("silver", F.lit(-1)), F.col("gold")
    complete = (F.count_if(g.isNull()) == 0) & (F.count("*") > 0)
    share = lambda cond: F.when(complete, F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)), 6))
    differ = lambda k: F.when(complete, F.count_if(F.abs(s - g) >= k)).otherwise(0)
    return pairs.agg(
        F.count("*").alias("rows_total"), F.count("gold").alias("rows_filled"), (F.count_if(g.isNull()) == 0).alias("complete"), share(s == g).alias("exact"), share(F.abs(s - g) <= 1).alias("within_1"), *[differ(k).alias(f"disagree_ge{k}_count") for k in (1, 2)]
    )


#: fixed values: (grade that is crossed, text for up, text for down)
CROSSINGS = ((2, "silver<2->gold>=2", "silver>=2->gold<2"), (3, "silver<3->gold==3", "silver==3->gold<3"))


def crossings(pairs: DataFrame) -> DataFrame:
    """Graded rows whose gold grade is on the other side of relevant or perfect than the silver one, with what crossed."""
    s, g = F.coalesce("silver", F.lit(-1)), F.col("gold")
    said = [F.when((s < k) & (g >= k), F.lit(up)).when((s >= k) & (g < k), F.lit(down)) for k, up, down in CROSSINGS]
    return pairs.withColumn("crossing", F.concat_ws("; ", *said)).where("crossing <> ''")


def filled_by_query(pairs: DataFrame) -> DataFrame:
    """(qid, filled, changed) of a regrade sheet; pairs: qid, silver, gold."""
    return pairs.groupBy("qid").agg(F.count("gold").alias("filled"), F.count_if(F.col("gold").isNotNull() & ~F.col("gold").eqNullSafe(F.col("silver"))).alias("changed"))


def audit(rows: DataFrame, suspects: list[str], k: int = 5, include_rules: bool = True) -> DataFrame:
    """(qid, id, reasons) of labels that a person should look at; rows: qid, id, rank, grade, confidence. include_rules: also by confidence and grade, not by the list of queries alone."""
    best = rows.groupBy("qid", "id").agg(F.min("rank").alias("rank"), F.first("grade").alias("grade"), F.first("confidence").alias("confidence"))
    found = [F.when(F.col("qid").isin(*suspects), F.lit("qid_in_audit_list")) if suspects else F.lit(None).cast("string")]
    if include_rules:
        found += [F.when(F.col("confidence") == "low", F.lit("silver_confidence_low")), F.when((F.col("grade") == 1) & (F.col("rank") < k), F.lit(f"silver_grade_1_in_top_{k}")), F.when(F.col("grade").isNull(), F.lit("silver_grade_null"))]
    return best.withColumn("reasons", F.array_compact(F.array(*found))).where(F.size("reasons") > 0).select("qid", "id", "reasons")


def top_modes(rows: DataFrame, k: int = 5) -> DataFrame:
    """(qid, id, modes): rows that some mode has in its top k, with the sorted modes."""
    return rows.where(F.col("rank") < k).groupBy("qid", "id").agg(F.array_sort(F.collect_set("mode")).alias("modes"))


def sheet_diff(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, problem): rows that lack, are extra, or differ in a field."""
    e, a = expected.select(*keys, *fields).withColumn("in_e", F.lit(True)).alias("e"), actual.select(*keys, *fields).withColumn("in_a", F.lit(True)).alias("a")
    cond = None
    for k in keys:
        c = F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}"))
        cond = c if cond is None else cond & c
    changed = F.array_compact(F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    problem = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(F.size(changed) > 0, F.concat(F.lit("changed: "), F.array_join(changed, ",")))
    # a full outer join as a left join and an anti join: both sides may be split where a key is frequent
    left = e.join(a, cond, "left").select(*[F.col(f"e.{k}").alias(k) for k in keys], problem.alias("problem"))
    extra = actual.alias("a").join(expected.alias("e"), cond, "left_anti").select(*keys, F.lit("unexpected").alias("problem"))
    return left.where("problem is not null").unionByName(extra)


def pending(todo: DataFrame, log: DataFrame, keys: list[str], model: str | None = None) -> DataFrame:
    """Rows without a graded log entry: what a resumed run has to do. model: entries of other models don't count."""
    done = log.where("grade is not null")
    done = done if model is None else done.where(F.col("model") == model)
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def parse_gate(rows: DataFrame, order: str, ok: Column, first: int = 20, least: float = 0.95) -> DataFrame:
    """(rate, passed) over the first rows of a run."""
    head = rows.orderBy(order).limit(first)
    return head.agg(F.count("*").alias("n"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6).alias("rate")).withColumn("passed", (F.col("n") < first) | (F.col("rate") >= least))


def counts(df: DataFrame, keys: list[str], frame: DataFrame | None = None) -> DataFrame:
    """Row counts by keys; with frame, its keys without rows count 0."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return out if frame is None else frame.select(*keys).distinct().join(out, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def errors(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows with `errors`: the messages whose condition is true. Null conditions count as bad."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(m)) for m, bad in checks.items()]))
    return df.withColumn("errors", found)


def rates(rows: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """(group, queries, name ...): the share of rows for which each flag holds, to four digits; null counts as no."""
    return rows.groupBy(group).agg(F.count("*").alias("queries"), *[F.round(F.avg(F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)), 4).alias(n) for n, c in flags.items()])
