"""Registered queries over records, labels, sheets and generated examples, each with its DuckDB oracle.

Validators get records made from templates by document, some of them broken: their oracles are the messages known for each template.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions import text as T
from quarry.operators import catalog, generate, intent, labels, records, regrade, render, store
from quarry.operators.index import expanded
from quarry.plans import oracle as O
from quarry.plans.queries import ASK_SQL, MAP, RANKED, SYNONYM_SQL, VOCAB_SQL, asks, genre_sql, gold, lab, ranked, vocabulary
from quarry.plans.registry import query
from quarry.session import table


def quoted(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def made(spark, sf, templates):
    """(doc_id, value): a template for each document, in turn, with its id filled in."""
    d = table(spark, sf, "documents").select("doc_id")
    return d.withColumn("value", F.replace(F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col("doc_id") % len(templates) + 1).cast("int")), F.lit("{id}"), F.col("doc_id").cast("string")))


def known(cases: list[tuple[str, str]]) -> str:
    """SQL of the messages that are known for each template."""
    return f"select doc_id, {quoted([m for _, m in cases])}[doc_id % {len(cases)} + 1] as errors from documents"


def found(spark, sf, cases, check):
    return made(spark, sf, [t for t, _ in cases]).select("doc_id", F.array_join(check(F.col("value")), "; ").alias("errors"))


GOOD_LABEL = '{"qid":"q1","tmdb_id":{id},"grade":2,"confidence":"high","reason":"ok","model":"m","ts":"2024-05-06T07:08:09Z"}'
LABELS = [
    (GOOD_LABEL, ""),
    ("[1]", "silver record must be an object"),
    ("{not json", "silver record must be an object"),
    (GOOD_LABEL.replace('"grade":2', '"grade":4'), "grade must be one of: 0, 1, 2, 3, None"),
    (GOOD_LABEL.replace('"grade":2', '"grade":true'), "grade must be one of: 0, 1, 2, 3, None"),
    (GOOD_LABEL.replace('"grade":2', '"grade":null'), 'confidence must be "low" when grade is None'),
    (GOOD_LABEL.replace('"grade":2', '"grade":null').replace("high", "low"), ""),
    (GOOD_LABEL.replace('"high"', '"sure"'), "confidence must be one of: high, low, medium"),
    (GOOD_LABEL.replace('"ok"', '"' + "x" * 241 + '"'), "reason must be <= 240 characters"),
    (GOOD_LABEL.replace('"tmdb_id":{id}', '"tmdb_id":"{id}"').replace(',"model":"m"', ""), "tmdb_id must be an integer; model is required"),
    (GOOD_LABEL.replace("09Z", "09"), "ts must be ISO-8601 UTC second precision ending in Z"),
    (GOOD_LABEL.replace("05-06", "13-06"), "ts must be parseable ISO-8601"),
    (GOOD_LABEL.replace('"qid"', '"more":1,"qid"'), "silver record has unexpected keys: more"),
]


@query("""with r as (select doc_id, source, n_chars % 7 as g, ['high', 'low', 'sure', 'medium'][doc_id % 4 + 1] as c, text, n_chars % 5 as t, doc_id % 11 as k from documents) select doc_id, concat_ws('; ', case when k = 3 then 'silver record has unexpected keys: lang' end, case when k = 5 then 'tmdb_id must be an integer' end, case when g in (4, 5) then 'grade must be one of: 0, 1, 2, 3, None' end, case when c = 'sure' then 'confidence must be one of: high, low, medium' end, case when g = 6 and c in ('high', 'medium') then 'confidence must be "low" when grade is None' end,
case when length(text) > 240 then 'reason must be <= 240 characters' end, case when k = 7 then 'model is required' end, case when t = 0 then 'ts must be ISO-8601 UTC second precision ending in Z' when t = 1 then 'ts must be parseable ISO-8601' end) as errors from r where source is not null and text is not null""")
def label_records(spark, sf):
    """A label made of every document's columns."""
    c, d = F.col, table(spark, sf, "documents").where("source is not null and text is not null")
    k, t, g = c("doc_id") % 11, c("n_chars") % 5, c("n_chars") % 7
    text = lambda x: F.to_json(F.struct(x.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(x.alias("x")))) - 6)  # noqa: E731  a JSON string
    day = F.when(t == 0, "2024-05-06T07:08:09").when(t == 1, "2024-13-06T07:08:09Z").otherwise("2024-05-06T07:08:09Z")
    sure = F.element_at(F.array(*[F.lit(x) for x in ("high", "low", "sure", "medium")]), (c("doc_id") % 4 + 1).cast("int"))
    line = F.concat(
        F.lit('{"qid":'), text(c("source")), F.lit(',"tmdb_id":'), F.when(k == 5, F.concat(F.lit('"'), c("doc_id").cast("string"), F.lit('"'))).otherwise(c("doc_id").cast("string")), F.lit(',"grade":'), F.when(g == 6, "null").otherwise(g.cast("string")), F.lit(',"confidence":"'), sure, F.lit('","reason":'), text(c("text")),
        F.when(k == 3, F.concat(F.lit(',"lang":'), text(F.coalesce("lang", F.lit(""))))).otherwise(""), F.when(k == 7, "").otherwise(',"model":"m"'), F.lit(',"ts":"'), day, F.lit('"}'),
    )
    return d.select("doc_id", F.array_join(records.label_errors(line), "; ").alias("errors"))


@query(known(LABELS))
def label_templates(spark, sf):
    return found(spark, sf, LABELS, records.label_errors)


GOOD_CANDIDATE = '{"qid":"q1","tmdb_id":{id},"movie_key":"k","title":"t","year":1999,"overview":"","genres":"","keywords":"","tagline":"","per_mode":{"basic":{"rank":0,"final_score":0.5}},"in_top_k_of":["basic"],"source":"union"}'
CANDIDATES = [
    (GOOD_CANDIDATE, ""),
    (GOOD_CANDIDATE.replace('"rank":0', '"rank":-1'), "per_mode.basic.rank must be >= 0"),
    (GOOD_CANDIDATE.replace('"rank":0,', ""), "per_mode.basic.rank is required"),
    (GOOD_CANDIDATE.replace('"rank":0', '"rank":0.5'), "per_mode.basic.rank must be an integer"),
    (GOOD_CANDIDATE.replace('"final_score":0.5', '"final_score":"x"'), "per_mode.basic.final_score must be a number"),
    (GOOD_CANDIDATE.replace('{"rank":0,"final_score":0.5}', "null"), "per_mode.basic must be an object, not None"),
    (GOOD_CANDIDATE.replace('{"rank":0,"final_score":0.5}', "3"), "per_mode.basic must be an object"),
    (GOOD_CANDIDATE.replace('"per_mode":{"basic"', '"per_mode":{"other"'), "per_mode has unexpected mode: other; in_top_k_of[0] must also appear in per_mode"),
    (GOOD_CANDIDATE.replace('{"basic":{"rank":0,"final_score":0.5}}', "{}").replace('["basic"]', "[]"), "per_mode must contain at least one mode"),
    (GOOD_CANDIDATE.replace('["basic"]', '["hybrid"]'), "in_top_k_of[0] must also appear in per_mode"),
    (GOOD_CANDIDATE.replace('["basic"]', '["basic",7]'), "in_top_k_of[1] must be a string"),
    (GOOD_CANDIDATE.replace('["basic"]', '["best"]'), "in_top_k_of[0] must be one of: advanced, basic, hybrid"),
    (GOOD_CANDIDATE.replace('["basic"]', '"basic"').replace("union", "unions"), 'source must be "union"; in_top_k_of must be a list'),
    (GOOD_CANDIDATE.replace('"year":1999', '"year":true').replace('"title":"t"', '"title":null'), "title must be a string; year must be an integer"),
]


@query(known(CANDIDATES))
def candidate_records(spark, sf):
    return found(spark, sf, CANDIDATES, records.candidate_errors)


GOOD_QUERY = '{"qid":"q07","query":"a duel {id}","notes":"","tags":{"era":"2015+","genre":["sf","other"],"vocab_distance":"low","length":"short","specificity":"high","ambiguity":"medium"}}'
GOOD_MOOD = GOOD_QUERY.replace('"ambiguity":"medium"', '"ambiguity":"medium","mood":{"current_emotion":"sad","desired_direction":"comfort_me","energy_level":"slow_gentle","intensity":"very_light","safety_sensitivity":"neutral"}')
IDS, ERAS = "qid must be one of: q01 to q20", "tags.era must be one of: 1980-2000, 2000-2015, 2015+, pre-1980"
QUERIES = [
    (GOOD_QUERY, ""),
    (GOOD_QUERY.replace("q07", "q21"), IDS),
    (GOOD_QUERY.replace('"notes":""', '"notes":"' + "n" * 201 + '"'), "notes must be <= 200 characters"),
    (GOOD_QUERY.replace('"2015+"', "null"), ERAS),
    (GOOD_QUERY.replace('["sf","other"]', "[]"), "tags.genre must be a non-empty list"),
    (GOOD_QUERY.replace('["sf","other"]', '["sf",3]'), "tags.genre[1] must be a string"),
    (GOOD_QUERY.replace('["sf","other"]', '["war"]'), "tags.genre[0] must be one of: action, animation, comedy, documentary, drama, horror, other, romance, sf, thriller"),
    (GOOD_MOOD, "tags has unexpected keys: mood"),
    (GOOD_QUERY.replace('"length":"short",', ""), "tags.length is required"),
    ('{"qid":"q01","query":"x","notes":"","tags":[]}', "tags must be an object"),
    ('{"qid":1,"query":"x"}', "qid must be a string; notes is required; tags is required"),
]
MOODS = [
    (GOOD_MOOD, ""),
    (GOOD_QUERY.replace('"2015+"', "null").replace("q07", "q65"), ""),
    (GOOD_MOOD.replace('"sad"', '"glad"'), "tags.mood.current_emotion must be one of: anxious, bored, heartbroken, lonely, sad, stressed, tired"),
    (GOOD_MOOD.replace('"intensity":"very_light",', '"force":1,'), "tags.mood has unexpected keys: force; tags.mood.intensity is required"),
    (GOOD_QUERY.replace('"ambiguity":"medium"', '"ambiguity":"medium","mood":[]'), "tags.mood must be an object"),
    (GOOD_QUERY.replace('"ambiguity":"medium"', '"ambiguity":"medium","mood":null'), ""),
    (GOOD_MOOD.replace("q07", "q66"), "qid must be one of: q01 to q65"),
]


@query(known(QUERIES))
def query_records(spark, sf):
    return found(spark, sf, QUERIES, records.query_errors)


@query(known(MOODS))
def mood_query_records(spark, sf):
    return found(spark, sf, MOODS, lambda c: records.query_errors(c, moods=True))


RULES = [
    ('{"match_type":"genre","pattern":"p{id}","add":["dark"]}', ""),
    ("  ", "blank line"),
    ('{"match_type":"genre","pattern":"twice","add":["dark"]}', "?"),
    ('{"match_type":"mood","pattern":"P{id}","add":[]}', "bad match_type mood; pattern must be non-empty lowercase; add must be a non-empty list"),
    ('{"match_type":"genre","pattern":"q{id}"}', "keys must be exactly match_type/pattern/add"),
    ('{"match_type":"keyword","pattern":"r{id}","add":["dark","glum"]}', "tags not in film enum: glum"),
    ("{oops", "bad JSON"),
    ('{"match_type":"keyword","pattern":" ","add":"dark","add2":1}', "keys must be exactly match_type/pattern/add"),
]


@query(f"with k as ({known(RULES)}), f as (select min(doc_id) as first from documents where doc_id % {len(RULES)} = 2) select doc_id as line, case when errors = '?' then 'duplicate pattern' else errors end as errors from k, f where errors <> '' and not (errors = '?' and doc_id = first)")
def rule_lines(spark, sf):
    return records.rule_errors(made(spark, sf, [t for t, _ in RULES]).withColumnRenamed("doc_id", "line")).withColumn("errors", F.array_join("errors", "; "))


@query("with r as (select doc_id as line, md5(lower(trim(text))) as k, case when doc_id % 5 = 0 then ['warm', 'dark'] when doc_id % 7 = 0 then ['glum'] else ['dark', 'warm'] end as tags, case when doc_id % 11 = 0 then 'guessed' else 'deterministic_rules' end as p from documents), x as (select *, min(line) over (partition by k) < line as again from r) select * from (select line, concat_ws('; ', case when p <> 'deterministic_rules' then 'provenance must be deterministic_rules' end, case when again then 'duplicate movie_key' end, case when tags = ['warm', 'dark'] then 'tags must be sorted and unique' end, case when tags = ['glum'] then 'tags not in film enum: glum' end) as errors from x) where errors <> ''")
def tag_lines(spark, sf):
    c = F.col("doc_id")
    strings = lambda *x: F.array(*[F.lit(v) for v in x])
    rows = table(spark, sf, "documents").select(c.alias("line"), F.md5(F.lower(F.trim("text"))).alias("movie_key"), F.when(c % 5 == 0, strings("warm", "dark")).when(c % 7 == 0, strings("glum")).otherwise(strings("dark", "warm")).alias("film_mood_tags"), F.when(c % 11 == 0, "guessed").otherwise("deterministic_rules").alias("provenance"))
    return records.tag_errors(rows).withColumn("errors", F.array_join("errors", "; "))


@query("""with f as (select lang as mood from documents where doc_id % 3 = 0 and lang is not null), w as (select lang as category, max(case when doc_id % 4 > 0 and lang <> 'de' then case when source = 'src1' then upper(source) else source end end) as word, source from documents where lang is not null group by all), n as (select source as sensation, case when n_chars % 50 = 0 then 'ice' else lang end as category from documents where lang is not null),
m as (select distinct case when n_chars % 40 = 0 then 'rage' else lang end as category, case when doc_id % 2 = 0 then 'desired' else 'avoid' end as side, source as tag from documents where lang is not null), dup as (select count(*) as n from (select mood from f group by mood having count(*) > 1))
select 'film_mood_vocab: duplicate moods' as error from dup where n > 0 union all select 'user_mood_vocab: empty category ' || category from w group by category having count(word) = 0 union all select distinct 'user_mood_vocab: non-lowercase word in ' || category from w where word <> lower(word)
union all select 'user_mood_vocab: body sensation ' || chr(39) || sensation || chr(39) || ' -> unknown category ' || chr(39) || category || chr(39) from n where category not in (select category from w) union all select distinct 'user_mood_map: categories mismatch (missing: ' || category || ')' from w where category not in (select category from m) union all select distinct 'user_mood_map: categories mismatch (extra: ' || category || ')' from m where category not in (select category from w)
union all select 'user_mood_map: ' || category || '.' || side || ' tag ' || chr(39) || tag || chr(39) || ' not in film enum' from m where tag not in (select mood from f) union all select 'user_mood_map: ' || category || ' has tags in both desired and avoid: ' || string_agg(tag, ', ' order by tag) from (select category, tag from m group by all having count(distinct side) = 2) group by category""")
def vocabulary_errors(spark, sf):
    """A vocabulary made of languages (categories) and sources (words, sensations, tags), with faults where numbers say so."""
    c, d = F.col, table(spark, sf, "documents").where("lang is not null")
    films = d.where("doc_id % 3 = 0").select(c("lang").alias("mood"))
    word = F.when((c("doc_id") % 4 > 0) & (c("lang") != "de"), F.when(c("source") == "src1", F.upper("source")).otherwise(c("source")))
    words = d.groupBy(c("lang").alias("category"), "source").agg(F.max(word).alias("word")).select("category", "word")
    sensations = d.select(c("source").alias("sensation"), F.when(c("n_chars") % 50 == 0, "ice").otherwise(c("lang")).alias("category"))
    moods = d.select(F.when(c("n_chars") % 40 == 0, "rage").otherwise(c("lang")).alias("category"), F.when(c("doc_id") % 2 == 0, "desired").otherwise("avoid").alias("side"), c("source").alias("tag")).distinct()
    return records.vocabulary_errors(films, words, sensations, moods)


@query("with a as (select distinct upper(lang) as v from documents where n_chars % 2 = 0 and lang is not null), b as (select distinct case when lang = 'en' then 'XX' else upper(lang) end as v from documents where lang is not null) select v as value, 'missing' as side from a where v not in (select v from b) union all select v, 'extra' from b where v not in (select v from a)")
def set_difference(spark, sf):
    d = table(spark, sf, "documents").where("lang is not null")
    return records.set_difference(d.where("n_chars % 2 = 0").select(F.upper("lang")), d.select(F.when(F.col("lang") == "en", "XX").otherwise(F.upper("lang"))))


# --- merged labels and sheets ---


@query("with g as (select doc_id as id, source as qid, (n_chars % 4)::int as grade, case when doc_id % 3 = 0 then 'guess' else 'ai_draft' end as p from documents where contains(text, 'idiot')), s as (select doc_id as id, 2 * toxic + (1 - quality) as grade from labels where substr(md5(doc_id::varchar), 1, 1) <> '0') select qid, g.id, 'invalid gold provenance' as errors from g where p = 'guess'")
def merge_invariants(spark, sf):
    g = gold(spark, sf).withColumns({"provenance": F.when(F.col("id") % 3 == 0, "guess").otherwise("ai_draft"), "notes": F.lit("n")})
    s = lab(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("qid")), "id")
    return labels.merge_errors(labels.gold_over_silver(s, g), regrade.PROVENANCES).withColumn("errors", F.array_join("errors", "; "))


def sheet_rows(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("id"), F.concat(F.lit("about "), F.col("source")).alias("query"), F.split("text", "\n").getItem(0).alias("title"))
    details = d.join(lab(spark, sf).withColumnRenamed("grade", "silver_grade"), "id", "left").withColumns({"silver_confidence": F.lit("high"), "silver_reason": F.lit("r")})
    r = ranked(spark, sf)
    return regrade.sheet([regrade.union_batch(r, details, 2, "retrieval_miss_audit", "again", ("src1", "src2")), regrade.union_batch(r, details, 3, "follow_up", "once more", ("src3",))])


SHEET = f"{RANKED}, u as (select qid, id, list_sort(list(distinct mode)) as modes from ranked where rank < 5 and qid in ('src1', 'src2', 'src3') group by qid, id), sh as (select u.qid, u.id, modes, 'about ' || u.qid as query, split_part(text, chr(10), 1) as title, lab.grade as silver_grade, case when u.qid = 'src3' then 3 else 2 end as batch from u join documents on doc_id = u.id left join lab on lab.id = u.id), sn as (select *, row_number() over (order by batch, qid, id) as line from sh)"


@query(f"with {SHEET} select line, qid, id, query, md5(title) as title, silver_grade, array_to_string(modes, ',') as in_top_5_of, case batch when 2 then 'again' else 'once more' end || ',' || array_to_string(list_transform(modes, lambda m: 'top_5_' || m), ',') as flag_reasons, batch, case batch when 2 then 'retrieval_miss_audit' else 'follow_up' end as batch_purpose from sn")
def regrade_sheet(spark, sf):
    return sheet_rows(spark, sf).select("line", "qid", "id", "query", F.md5("title").alias("title"), "silver_grade", F.array_join("in_top_5_of", ",").alias("in_top_5_of"), F.array_join("flag_reasons", ",").alias("flag_reasons"), "batch", "batch_purpose")


@query(f"with {SHEET} select 'total' as kind, '' as key, count(*) as n, null::int as grade from sn union all select 'batch', batch::varchar, count(*), null from sn group by batch union all select 'qid', qid, count(*), null from sn group by qid union all select 'row', qid || ':' || id, count(*), any_value(silver_grade) from sn group by qid, id")
def regrade_manifest(spark, sf):
    return regrade.manifest(sheet_rows(spark, sf))


@query(f"""with {SHEET}, n as (select max(line) as top from sn), p as (select line, qid, id, concat_ws('; ', case when line % 7 = 3 then 'title differs' end, case when line % 7 = 4 then 'silver_grade differs' end, case when line % 7 = 5 then 'gold_grade must be one of 0, 1, 2, 3' end, case when line % 7 = 6 and silver_grade is distinct from 1 then 'gold_notes must be given when the grade differs' end, case when line % 7 = 0 then 'label_provenance is unknown' end) as problems from sn where line % 7 not in (1, 2))
select * from p where problems <> '' union all select line, qid, id, 'missing row' from sn where line % 7 = 1 union all select top + 1, 'src9', 0, 'added row' from n""")
def regrade_check(spark, sf):
    want = sheet_rows(spark, sf)
    n, kind = F.col("line") % 7, want.columns
    got = want.withColumns(
        {
            "title": F.when(n == 3, "other").otherwise(F.col("title")), "silver_grade": F.when(n == 4, F.coalesce("silver_grade", F.lit(-1)) + 1).otherwise(F.col("silver_grade")),
            "gold_grade": F.when(n == 5, 7).when(n == 6, 1).when(n == 4, None).cast("int"), "gold_notes": F.when(n == 5, "n"), "label_provenance": F.when(n == 0, "human_gold").otherwise("ai_draft"),
        }
    ).where("line % 7 <> 1")
    more = want.orderBy(F.desc("line")).limit(1).withColumns({"line": F.col("line") + 1, "qid": F.lit("src9"), "id": F.lit(0).cast(want.schema["id"].dataType), "label_provenance": F.lit("ai_draft")})
    return regrade.check(got.unionByName(more.select(*kind, "label_provenance")), want).withColumn("problems", F.array_join("problems", "; "))


@query("select lang, count(*) as queries, round(avg(case when n_chars > 200 then 1.0 else 0.0 end), 4) as schema_validity_rate, round(avg(case when source in ('src1', 'src2') then 1.0 else 0.0 end), 4) as mode_accuracy, round(avg(case when contains(text, 'idiot') then 1.0 else 0.0 end), 4) as mood_false_positive_rate from documents group by lang")
def parser_rates(spark, sf):
    d = table(spark, sf, "documents")
    return labels.rates(d, "lang", {"schema_validity_rate": F.col("n_chars") > 200, "mode_accuracy": F.col("source").isin("src1", "src2"), "mood_false_positive_rate": F.contains("text", F.lit("idiot"))})


# --- rows of the catalog and the library ---


@query("with d as (select *, ['[''a'', ''b c'']', 'a| b;c,a', '', ' [] ', 'x'][doc_id % 5 + 1] as g from documents) select case when doc_id % 4 = 0 then doc_id + 1000 else doc_id end as tmdb_id, 'movie_id:' || (case when doc_id % 4 = 0 then doc_id + 1000 else doc_id end) as movie_key, case when doc_id % 3 = 0 then 2001 when doc_id % 3 = 1 then 1987 else 0 end as year, ['a,b c', 'a,b,c,a', '', '', 'x'][doc_id % 5 + 1] as genres, source as keywords, 0.0::double as vote_average, n_chars::int as vote_count, '' as backdrop_path from d")
def profile_rows(spark, sf):
    c = F.col("doc_id")
    g = F.element_at(F.array(*[F.lit(x) for x in ("['a', 'b c']", "a| b;c,a", "", " [] ", "x")]), (c % 5 + 1).cast("int"))
    rows = table(spark, sf, "documents").select(F.when(c % 4 == 0, (c + 1000).cast("string")).otherwise("").alias("tmdb_id"), c.alias("id"), F.col("text").alias("title"), F.when(c % 3 == 0, "2001").otherwise("nan").alias("year"), F.when(c % 3 == 1, "1987-01-02").otherwise("soon").alias("release_date"), g.alias("genres"), F.col("source").alias("keywords"), F.lit("nan").alias("vote_average"), F.col("n_chars").alias("vote_count"))
    return catalog.profile(rows).select("tmdb_id", "movie_key", "year", F.array_join("genres", ",").alias("genres"), F.array_join("keywords", ",").alias("keywords"), "vote_average", "vote_count", "backdrop_path")


@query("select doc_id as id, md5(text[1:500]) as overview, case when doc_id % 3 = 0 then 1999 when doc_id % 3 = 1 then 1987 else 0 end as year, coalesce(lang, '') as genres, '' as tagline, 0.0::double as vote_average from documents")
def candidate_rows(spark, sf):
    c, none = F.col("doc_id"), F.lit(None).cast("string")
    rows = table(spark, sf, "documents").select(c.alias("id"), F.lit("t").alias("title"), F.when(c % 3 == 1, "1987-01-02").otherwise("soon").alias("release_date"), F.when(c % 3 == 0, 1999).alias("year"), F.col("lang").alias("genres_clean"), F.lit("").alias("genres"), F.col("text").alias("overview"), none.alias("poster_path"), none.alias("vote_average"), F.col("n_chars").alias("vote_count"), F.col("source").alias("keywords_clean"), none.alias("tagline"))
    return catalog.candidate(rows).select("id", F.md5("overview").alias("overview"), "year", "genres", "tagline", "vote_average")


@query("with k as (select doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g')) as t from documents) select doc_id, case when doc_id % 4 = 1 then 'movie_id:' || doc_id when t <> '' then 'title:' || t || '|year:' || case when doc_id % 3 = 0 then '2001' when doc_id % 3 = 1 then '1987' else '' end else 'id:' || doc_id end as k from k")
def given_keys(spark, sf):
    c = F.col("doc_id")
    key = T.item_key(F.split("text", "\n").getItem(0), F.when(c % 3 == 0, 2001).cast("int"), c, F.when(c % 4 == 1, c.cast("string")).when(c % 4 == 2, ""), F.when(c % 3 == 1, "1987-01-02").otherwise("soon"))
    return table(spark, sf, "documents").select("doc_id", key.alias("k"))


@query("with t as (select user_id, event_type, count(*) % 2 = 1 as watched from events group by all) select user_id, event_type, 'watched' as view from t where watched union all select user_id, event_type, 'unwatched' from t where not watched union all select user_id, event_type, 'all' from t")
def library_views(spark, sf):
    t = store.toggled(table(spark, sf, "events"), ["user_id", "event_type"], "ts")
    views = [t.where(store.watch_filter(v, F.col("watched"))).select("user_id", "event_type", F.lit(v).alias("view")) for v in ("all", "watched", "unwatched")]
    return views[0].unionByName(views[1]).unionByName(views[2])


@query("select event_id, strftime(to_timestamp(floor(epoch_us(ts) / 1000000)) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as ts from events")
def utc_stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", T.utc_stamp(F.col("ts")).alias("ts"))


@query("select doc_id from documents where doc_id % 7 = 0")
def sampled_list(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") + 1).alias("number"))
    return render.every_nth(d, "number", 7).select("doc_id")


# --- query side ---

@query(f"with {ASK_SQL}, x as (select conv_id, turn, {O.tokens('text')} as x from a) select conv_id, turn, array_to_string(flatten([x, {SYNONYM_SQL}]), ' ') as terms from x")
def query_expansion(spark, sf):
    return asks(spark, sf).select("conv_id", "turn", F.array_join(expanded(F.col("text")), " ").alias("terms"))


FILMS = "f(i, mood) as (values " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(sorted(rules.FILM_MOODS))) + ")"


def films(spark):
    return spark.createDataFrame(list(enumerate(sorted(rules.FILM_MOODS))), "i int, mood string")


def flat(df):
    return df.withColumns({n: F.array_join(n, ",") for n in ("desired", "avoid")})


@query(f"with {VOCAB_SQL}, f(form) as (values ('{{w1}} and {{w2}}'), ('both {{w1}}, {{w2}}')) select a.category, a.word as w1, b.word as w2, replace(replace(form, '{{w1}}', a.word), '{{w2}}', b.word) as text from v a join v b on a.category = b.category and a.n < b.n, f")
def word_pairs(spark, sf):
    return generate.word_pairs(vocabulary(spark, sf), ["{w1} and {w2}", "both {w1}, {w2}"])


@query(f"with {MAP}, {VOCAB_SQL} select a.category as c1, b.category as c2, a.word || ' and ' || b.word as text, array_to_string(list_sort(list_distinct(list_concat(x.desired, y.desired))), ',') as desired, array_to_string(list_sort(list_filter(list_distinct(list_concat(x.avoid, y.avoid)), lambda m: not list_contains(list_concat(x.desired, y.desired), m))), ',') as avoid from v a join v b on a.category < b.category and a.n < 2 and b.n < 2 join mm x on x.category = a.category join mm y on y.category = b.category")
def category_pairs(spark, sf):
    return flat(generate.category_pairs(vocabulary(spark, sf), "{w1} and {w2}", 2))


@query(f"with {MAP}, {VOCAB_SQL}, {FILMS}, x as (select category, word, mood, list_distinct(list_append(desired, mood)) as d, avoid from v join mm using (category), f where n < 2) select category, case (length(word) + length(mood)) % 2 when 0 then word || ', want ' || case when substr(mood, 1, 1) in ('a', 'e', 'i', 'o', 'u') then 'an ' else 'a ' end || mood || ' one' else word || ' but ' || mood end as text, array_to_string(list_sort(d), ',') as desired, array_to_string(list_sort(list_filter(avoid, lambda m: not list_contains(d, m))), ',') as avoid from x")
def word_moods(spark, sf):
    return flat(generate.word_moods(vocabulary(spark, sf), films(spark), ["{w}, want {am} one", "{w} but {m}"], 2))


@query(f"with {MAP}, {VOCAB_SQL}, {FILMS}, x as (select v.category, word, a.mood as m, b.mood as l, list_filter(list_distinct(list_append(desired, a.mood)), lambda t: t <> b.mood) as d, list_distinct(list_append(avoid, b.mood)) as v from v join mm using (category), f a, f b where n < 2 and a.i % 3 = 0 and b.i % 4 = 1 and a.mood <> b.mood) select category, case (length(word) + length(l)) % 3 when 0 then word || ' + ' || m || ' - ' || l when 1 then word || ': ' || m || ', no ' || l else 'not ' || l || ' but ' || m || ' (' || word || ')' end as text, array_to_string(list_sort(d), ',') as desired, array_to_string(list_sort(list_filter(v, lambda t: not list_contains(d, t))), ',') as avoid from x")
def wish_triples(spark, sf):
    return flat(generate.wishes(vocabulary(spark, sf), films(spark), ["{w} + {m} - {a}", "{w}: {m}, no {a}", "not {a} but {m} ({w})"], 2))


@query("with t as (select doc_id::int as i, 'a ' || source as shown, source || doc_id as gold from documents where doc_id >= 0) select a.gold as g1, b.gold as g2, case (a.i + b.i - a.i - 1) % 2 when 0 then a.shown || ' and ' || b.shown else b.shown || ' with ' || a.shown end as text from t a join t b on b.i > a.i and b.i <= a.i + 8")
def topic_neighbours(spark, sf):
    d = table(spark, sf, "documents").where("doc_id >= 0").select(F.col("doc_id").cast("int").alias("i"), F.concat(F.lit("a "), "source").alias("shown"), F.concat("source", F.col("doc_id").cast("string")).alias("gold"))
    return generate.neighbours(d, ["{a} and {b}", "{b} with {a}"])


AN = "case when {0}[1] in ('a', 'e', 'i', 'o', 'u') then 'an ' else 'a ' end || {0}"


@query(f"with {VOCAB_SQL}, p as (select category, max(word) filter (n = 0) as place from v group by category), h as (select place, {AN.format("(place || ' drama')")} as head, category from p) select place as plot, 'Drama' as genre, head as text from h union all select place || ',' || word, 'Drama', head || ' about the ' || word from h join v using (category) where n in (1, 2)")
def place_compounds(spark, sf):
    v = vocabulary(spark, sf)
    objects = v.where("n in (1, 2)").groupBy("category").agg(F.collect_list(F.struct(F.concat(F.lit("the "), "word").alias("shown"), F.col("word").alias("gold"))).alias("objects"))
    p = v.where("n = 0").select("category", F.col("word").alias("place")).join(objects, "category").select("place", F.lit("drama").alias("word"), F.lit("Drama").alias("genre"), "objects")
    return generate.compounds(p, "{head}", "{head} about {o}").withColumn("plot", F.array_join("plot", ","))


IMPLIED_FORMS = [(0, "where {ph}"), (0, "{ph}, a story"), (1, "{ph}"), (2, "about {ph}")]


@query(f"with {VOCAB_SQL}, f(kind, form) as (values {', '.join(f"({k}, '{f}')" for k, f in IMPLIED_FORMS)}), x as (select a.word || '-' || b.word as concept, replace(form, '{{ph}}', 'the ' || a.word || ' of a ' || c.word) as text from v a join v b on b.category = a.category and b.n = a.n + 1 join v c on c.category = a.category and c.n = (a.n + 2) % 6 join f on f.kind = a.n % 3) select concept, text, contains(lower(text), concept) or len(list_intersect(string_split(replace(lower(text), '-', ' '), ' '), list_filter(string_split(replace(concept, '-', ' '), ' '), lambda w: length(w) > 2))) > 0 as leaks from x")
def implied_concepts(spark, sf):
    v = vocabulary(spark, sf)
    a, b, c = (v.select("category", F.col("n").alias(f"n{i}"), F.col("word").alias(f"w{i}")) for i in "abc")
    p = a.join(b, "category").where("nb = na + 1").join(c, "category").where("nc = (na + 2) % 6").select(F.concat_ws("-", "wa", "wb").alias("concept"), (F.col("na") % 3).alias("kind"), F.concat(F.lit("the "), "wa", F.lit(" of a "), "wc").alias("phrase"))
    return generate.implied(p, spark.createDataFrame(IMPLIED_FORMS, "kind int, form string"))


@query("select doc_id, case when contains(' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ', ' warm ') then 'warm' else '' end as mixed from documents")
def separated_clauses(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.lit("something epic").alias("want"))
    return generate.separation(d, "text", "want", ("blue", "low"), ("warm",)).select("doc_id", F.array_join("mixed", ",").alias("mixed"))


@query("select 'lang' as field, lang as value, count(*) as n from documents where lang not in ('en', 'de') group by lang union all select 'source', source, count(*) from documents where source not in ('src1') group by source")
def outside_vocabulary(spark, sf):
    d = table(spark, sf, "documents").select(F.array("lang").alias("lang"), F.array("source").alias("source")).where(F.col("lang")[0].isNotNull() & F.col("source")[0].isNotNull())
    return generate.outside(d, {"lang": ("en", "de"), "source": ("src1",)})


#: a model's replies made of each turn's columns
@query(f"with {ASK_SQL}, r as (select a.conv_id, a.turn, a.text, c.role, a.turn % 4 as k from a join conversations c on a.conv_id = c.conv_id and a.turn = c.turn), x as (select *, {genre_sql('text')} as g from r) select conv_id, turn, case when k in (0, 1) then concat_ws(',', role, 'turn ' || turn, 'x1', 'x2', 'x3', 'x4', 'x5', 'x6') else '' end as plot, array_to_string(case when k = 0 then list_concat(g, list_filter(['Thriller', 'War'], lambda w: not list_contains(g, w))) else g end, ',') as include, case when k = 0 then 'Horror' else '' end as exclude from x")
def intent_tier2(spark, sf):
    words = intent.lexicon(spark.createDataFrame([("fear", "afraid")], "category string, word string"))
    k = F.col("turn") % 4
    plot = F.concat(F.lit('"plot_elements": [" '), "role", F.lit(' ", "", "turn '), F.col("turn").cast("string"), F.lit('", "x1", "x2", "x3", "x4", "x5", "x6", "x7"]'))
    reply = F.when(k == 0, F.concat(F.lit("{"), plot, F.lit(', "genres_include": ["Thriller", "Noir", "War"], "genres_exclude": ["Horror"]}'))).when(k == 1, F.concat(F.lit("{"), plot, F.lit("}"))).when(k == 2, F.concat(F.lit('{"plot_elements": "'), "role", F.lit('"}')))
    rows = asks(spark, sf).join(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"]).withColumn("reply", reply).withColumn("mode", F.lit(None).cast("string"))
    out = intent.merge_extracted(intent.parse_tier1(rows, words), "reply")
    return out.select("conv_id", "turn", *[F.array_join(f"intent.{c}", ",").alias(n) for n, c in (("plot", "plot_elements"), ("include", "genres_include"), ("exclude", "genres_exclude"))])


READINGS = [
    ("I feel lonely and want something with comfort", "lonely", "safe_hopeful", "comfort_me"), ("I'm sad, give me a dark movie", "sad", "neutral", None), ("a disturbing horror", None, "dark_intended", None), ("a stressed detective hunts a killer", None, "neutral", None),
    ("really tired from work, want something cozy", "tired", "safe_hopeful", "calm_me_down"), ("I am in a melancholy mood", "melancholy", "safe_hopeful", None), ("make me laugh", None, "neutral", "cheer_me_up"), ("", None, "neutral", None),
]


def literal(x) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


@query("with k(i, emotion, safety, direction) as (values " + ", ".join(f"({i}, " + ", ".join(literal(x) for x in row[1:]) + ")" for i, row in enumerate(READINGS)) + f") select doc_id, emotion, safety, direction from documents join k on i = doc_id % {len(READINGS)} where contains('0123456789', source[4])")
def mood_readings(spark, sf):
    """What people say before the name of each document's source, which tells no mood."""
    said = F.element_at(F.array(*[F.lit(r[0]) for r in READINGS]), (F.col("doc_id") % len(READINGS) + 1).cast("int"))
    d = table(spark, sf, "documents").where("contains('0123456789', substring(source, 4, 1))")
    rows = intent.mood_intent(d.select("doc_id", F.concat_ws(" ", said, F.lit("/"), "source").alias("text")), "text", "m")
    return rows.select("doc_id", F.col("m.current_emotion").alias("emotion"), F.col("m.safety_sensitivity").alias("safety"), F.col("m.desired_direction").alias("direction"))
