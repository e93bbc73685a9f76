"""Examples with known answers, and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions import text as T
from quarry.operators import catalog, dedup, evaluate, fusion, generate, intent, labels, store
from quarry.operators.index import TextIndex, query_terms
from quarry.plans import plugins


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(expr(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_text_functions(spark):
    assert column(spark, T.safe_text, [" a ", "NaN", None, "null", " x\t", "na"]) == ["a", "", "", "", "x", ""]
    assert column(spark, T.clean_list, ["a, b,,a", None, " "]) == ["a, b", "", ""]
    assert column(spark, T.is_true, ["True", "1", "yes", "no", None]) == [True, True, True, False, False]
    assert column(spark, T.fold, ["Éàü ñ", "日本x", None]) == ["eau n", "x", ""]
    assert column(spark, T.fold_exact, ["ﬁn ½"]) == ["fin 12"]
    words = ["running", "stories", "tried", "boxes", "cats", "is", "painters", "thing"]
    assert column(spark, T.stem, words) == ["runn", "story", "tried", "boxe", "cats", "is", "paint", "thing"]
    assert column(spark, lambda c: T.to_int(c), ["3.9", "x", None, "nan", "1e30"]) == [3, 0, 0, 0, 0]
    assert column(spark, lambda c: T.decade(T.year_of(c)), ["1994-05-06", "2003-1-2", "bad", None]) == ["1990s", "2000s", "", ""]
    assert column(spark, T.loose_list, ["['a', 'b']", "a|b;c,a", "[1, x y]", "[]", " ", None]) == [["a", "b"], ["a", "b", "c", "a"], ["1", "x y"], [], [], []]


def test_bm25_by_hand(spark):
    df = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, "green"), (4, "grey")], "id long, t string")
    ix = TextIndex.build(df, "id", {"t": F.col("t")})
    got = {r["id"]: r["bm25_score"] for r in ix.search(["red", "red"], {"t": 1.0}).collect()}
    idf, avg = math.log(3.5) - math.log(1.5), 7 / 4
    want = 2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert set(got) == {1} and got[1] == pytest.approx(want)
    assert ix.search([]).count() == 0
    assert "hitman" in query_terms(spark, "an assassin") and query_terms(spark, "", True) == []
    from quarry.plans import queries

    assert query_terms(spark, queries.ASKED) == queries.TERMS and query_terms(spark, queries.FILTERED) == queries.FILTERED_TERMS


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "red fox"), (2, "blue fox"), (3, "sky")], "id long, t string")
    ix = TextIndex.build(df, "id", {"t": F.col("t")})
    ix.write(str(tmp_path / "ix"))
    back = TextIndex.read(spark, str(tmp_path / "ix"))
    assert sorted(map(tuple, back.search(["red"], {"t": 1.0}).collect())) == sorted(map(tuple, ix.search(["red"], {"t": 1.0}).collect()))


def test_catalog(spark):
    base = dict(vote_average="7", vote_count="60", status="Released", release_date="2001-02-03", runtime="x", adult="False", homepage="", original_language="en", original_title="T", overview="o" * 50, popularity="1", poster_path="", tagline="none", genres="Drama, War,Drama", production_companies="", spoken_languages="", keywords="k")
    rows = [base | {"id": "1", "title": " T "}, base | {"id": "2", "title": "t"}, base | {"id": "3", "title": "U", "overview": "o" * 49}, base | {"id": "4", "title": "V", "vote_count": "49"}, base | {"id": "5", "title": "W", "adult": "1"}, base | {"id": "6", "title": "X", "release_date": "?"}]
    built = catalog.build_catalog(spark.createDataFrame(rows), [F.col("id")])
    out = {r["id"]: r for r in built.collect()}
    assert set(out) == {1, 6}
    assert out[1]["document"].split("\n") == ["Title: T", "Year: 2001 (2000s)", "Genres: Drama, War", "Plot: " + "o" * 50, "Themes and topics: k"]
    assert (out[1]["genres"], out[1]["genres_clean"]) == ("Drama, War,Drama", "Drama, War")
    flat = catalog.metadata(built).orderBy("tmdb_id").first()
    assert (flat["vec_key"], flat["genres"], flat["runtime"], flat["year"]) == ("tmdb_1", "Drama, War,Drama", 0, 2001)
    with pytest.raises(Exception, match="positive id"):
        catalog.metadata(built.withColumn("id", F.lit(0))).collect()
    assert out[6]["year"] is None and out[6]["document"].startswith("Title: X\nOriginal title: T")
    with pytest.raises(ValueError):
        catalog.require(spark.range(1), ["title"])


def metric_rows(spark, rows):
    return spark.createDataFrame([("q", i, "basic", r, g) for i, (r, g) in enumerate(rows)], "qid string, id long, mode string, rank int, grade int")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(0, 0), (1, 1), (4, 2)], {"hit": 1.0, "mrr": 0.2, "strict_hit": 0.0}),
        ([(0, 1), (1, 1)], {"hit": 0.0, "mrr": 0.0}),
        ([(0, 3), (1, None), (2, 0)], {"hit": 1.0, "mrr": 1.0, "ndcg": None}),
        ([(0, 0), (1, None), (2, 0)], {"hit": None, "mrr": None}),
        ([(0, None), (1, 3)], {"hit": 1.0, "mrr": None, "strict_hit": 1.0}),
        ([(0, 2), (1, None)], {"mrr": 1.0, "strict_hit": None}),
        ([(0, 3), (1, 2), (2, 1), (3, 0), (4, 3)], {"ndcg": round((1 + 0.7 / math.log2(3) + 0.3 / 2 + 1 / math.log2(6)) / (1 + 1 / math.log2(3) + 0.7 / 2 + 0.3 / math.log2(5)), 6)}),
        ([(0, 0), (1, 0)], {"hit": 0.0, "mrr": 0.0, "ndcg": None}),
    ],
)
def test_metrics(spark, rows, want):
    out = evaluate.metrics(metric_rows(spark, rows), 5, ("basic", "hybrid"))
    got = {r["mode"]: r for r in out.collect()}
    assert {k: got["basic"][k] for k in want} == want
    assert got["hybrid"]["hit"] == 0.0


def test_union_selection(spark):
    def union(lists):
        rows = [("q", i, m, r) for m, ids in lists.items() for r, i in enumerate(ids)]
        return [r["id"] for r in evaluate.candidate_union(spark.createDataFrame(rows, "qid string, id long, mode string, rank int")).orderBy("pos").collect()]

    assert sorted(union({"basic": range(1, 6), "advanced": range(11, 16), "hybrid": range(21, 26)})) == [*range(1, 6), *range(11, 16), *range(21, 26)]
    assert union({m: range(1, 13) for m in evaluate.MODES}) == list(range(1, 9))


def test_labels(spark):
    s = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 1), ("q", 4, 3)], "qid string, id long, grade int")
    g = spark.createDataFrame([("q", 1, 3), ("q", 2, 2), ("q", 3, 0), ("q", 4, 1), ("q", 9, 2)], "qid string, id long, grade int")
    merged = {r["id"]: (r["grade"], r["label_provenance"]) for r in labels.gold_over_silver(s, g).collect()}
    assert merged == {1: (3, "gold_overrides"), 2: (2, "gold_agrees"), 3: (0, "gold_overrides"), 4: (1, "gold_overrides"), 9: (2, "gold_only")}
    pairs = spark.createDataFrame([(1, 3), (2, 2), (1, 0), (3, 1)], "silver int, gold int")
    a = labels.agreement(pairs).first()
    assert (a["exact"], a["within_1"], a["disagree_ge1_count"], a["disagree_ge2_count"]) == (0.25, 0.5, 3, 2)
    assert sorted((r["silver"], r["gold"], r["crossing"]) for r in labels.crossings(pairs).collect()) == [(1, 3, "silver<2->gold>=2; silver<3->gold==3"), (3, 1, "silver>=2->gold<2; silver==3->gold<3")]
    assert labels.agreement(spark.createDataFrame([(1, None)], "silver int, gold int")).first()["exact"] is None
    with pytest.raises(ValueError):
        labels.assert_empty(labels.missing_matches(g, s, ["qid", "id"]), "gold without silver")


def test_safety_and_mood_order(spark):
    rows = spark.createDataFrame([(0, "Horror", ["bleak", "dark"]), (1, "Drama", []), (2, "Drama", ["hopeful", "warm"])], "pos int, genres string, tags array<string>")
    assert [r["genres"] for r in fusion.demote(rows, "pos", fusion.is_dark(F.col("genres"))).orderBy("pos").collect()] == ["Drama", "Drama", "Horror"]
    assert [r["tags"] for r in fusion.mood_order(rows, "pos", "tags", ["hopeful", "warm"], ["bleak"]).orderBy("pos").collect()] == [["hopeful", "warm"], [], ["bleak", "dark"]]
    assert column(spark, lambda c: fusion.is_dark(c), ["terrorism", "a serial killer", "Terror!"]) == [False, True, True]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 30), unique=True, max_size=8), st.lists(st.integers(0, 30), unique=True, max_size=8))
def test_rrf_is_symmetric(a, b):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    sem = lambda x: spark.createDataFrame([(i, 1.0, r) for r, i in enumerate(x)], "id long, semantic_score double, semantic_rank int")
    txt = lambda x: spark.createDataFrame([(i, 1.0, r) for r, i in enumerate(x)], "id long, bm25_score double, bm25_rank int")
    one = {r["id"]: r["rrf_score"] for r in fusion.rrf(sem(a), txt(b)).collect()}
    two = {r["id"]: r["rrf_score"] for r in fusion.rrf(sem(b), txt(a)).collect()}
    assert one == two and set(one) == {*a, *b}


def test_dedup_fills_gaps_and_is_idempotent(spark):
    df = spark.createDataFrame([("k", 1, 0.5, "a", None), ("k", 2, 0.9, "", 4.0), ("j", 3, None, "z", None)], "key string, pos int, score double, text string, extra double")
    once = dedup.best_merge(df, "key", F.col("score"), "pos", {"text": ""}, ("extra",))
    assert sorted(map(tuple, once.collect())) == [("j", 3, None, "z", None), ("k", 1, 0.9, "a", 4.0)]
    assert sorted(map(tuple, dedup.best_merge(once, "key", F.col("score"), "pos", {"text": ""}, ("extra",)).collect())) == sorted(map(tuple, once.collect()))


def test_intent(spark):
    words = intent.lexicon(spark.createDataFrame([("despair_sad", "sad"), ("fear", "anxious"), ("stressed_tense", "anxious"), ("stressed_tense", "on edge"), ("tender", "calm"), ("tender", "caring"), ("accepting_open", "calm")], "category string, word string"))
    rows = [("feeling sad, want something warm and funny", None), ("feeling calm and caring", None), ("a tense thriller from the 80s", None), ("on edge", "mood"), ("sad", "category")]
    out = [r["intent"] for r in intent.parse_tier1(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, text string, mode string"), words).orderBy("i").collect()]
    assert out[0]["user_moods"] == ["despair_sad"] and out[0]["desired_film_moods"] == ["heartwarming", "hopeful", "uplifting", "warm"] and out[0]["mode"] == "mood"
    assert out[1]["user_moods"] == ["tender"]
    assert out[2]["user_moods"] == [] and out[2]["genres_include"] == ["Thriller"] and (out[2]["era"]["min_year"], out[2]["era"]["max_year"]) == (1980, 1989) and out[2]["mode"] == "content"
    assert out[3]["user_moods"] == ["stressed_tense"] and out[4]["mode"] == "category"


@pytest.mark.parametrize(
    "text, emotion, safety, direction",
    [
        ("I feel lonely and want something with comfort", "lonely", "safe_hopeful", "comfort_me"),
        ("I'm sad, give me a dark movie", "sad", "neutral", None),
        ("a disturbing horror", None, "dark_intended", None),
        ("a stressed detective hunts a killer", None, "neutral", None),
        ("really tired from work, want something cozy", "tired", "safe_hopeful", "calm_me_down"),
        ("I am in a melancholy mood", "melancholy", "safe_hopeful", None),
    ],
)
def test_mood_intent(spark, text, emotion, safety, direction):
    m = intent.mood_intent(spark.createDataFrame([(text,)], "q string"), "q").first()["mood"]
    assert (m["current_emotion"], m["safety_sensitivity"], m["desired_direction"]) == (emotion, safety, direction)


def test_predicates_and_state(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, "9")], "id int, v string")
    assert [r["id"] for r in df.where(fusion.predicate({"v": "x"}, {"v": F.col("v")})).collect()] == [r["id"] for r in df.where(fusion.predicate({"v": {"$eq": "x"}}, {"v": F.col("v")})).collect()] == [2]
    assert [r["id"] for r in df.where(fusion.predicate({"v": {"$gt": 4, "$lt": 9}, "none": 1}, {"v": F.col("v")})).collect()] == [1]
    e = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3)], "id int, v string, o int")
    assert sorted(map(tuple, store.upsert(e.where("o < 2"), e.where("o >= 2"), "id", "o", ()).select("id", "v").collect())) == [(1, "b"), (2, "c")]
    assert store.reroll(3, 3) == 1
    assert [r["split"] for r in spark.range(1, 22).select(generate.split(F.col("id")).alias("split")).collect()][17:] == ["train", "val", "test", "train"]
    assert spark.createDataFrame([(["sad"], "x"), (["warm"] * 4, " ")], "m array<string>, text string").transform(lambda d: generate.invariants(d, "m")).where("violations > 0").count() == 3


def test_bootstrap_seeded():
    import random

    assert evaluate.bootstrap_seeded([0.5] * 10, random.Random(42)) == 0
    one, same = random.Random(42), random.Random(42)
    assert evaluate.bootstrap_seeded([1.0], one) == 0 and evaluate.bootstrap_seeded([], one) == 0
    for _ in range(1000):
        same.randrange(1)
    assert one.random() == same.random()  # one value draws, none doesn't
    assert 0 < evaluate.bootstrap_seeded([0.0, 1.0] * 5, random.Random(42)) < 0.5


def test_files(spark, tmp_path):
    from quarry.sources import files

    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n')
    assert files.read_csv(spark, str(tmp_path / "a.csv"), ["text"]).first()["text"] == 'two\nlines, "quoted"'
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": "x"\n')
    assert [(r["line"], r["error"]) for r in files.jsonl_errors(spark, str(tmp_path / "b.jsonl"), "a int").orderBy("line").collect()] == [(3, "not an object"), (4, "invalid JSON or types")]
    files.write_jsonl(spark.createDataFrame([(None, 2)], "b string, a int"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":2,"b":null}'
    files.write_small(str(tmp_path / "r" / "m.json"), {"x": 1})
    files.write_new(str(tmp_path / "n.txt"), "x")
    with pytest.raises(FileExistsError):
        files.write_new(str(tmp_path / "n.txt"), "x")
    with pytest.raises(TypeError):
        files.write_small(str(tmp_path / "r" / "bad.json"), {"x": object()})
    assert [p.name for p in (tmp_path / "r").iterdir()] == ["m.json"]
    lines = files.numbered_lines(spark, str(tmp_path / "b.jsonl")).orderBy("line").collect()
    assert [(r["line"], r["value"]) for r in lines] == [(1, '{"a": 1}'), (2, ""), (3, "[1]"), (4, '{"a": "x"')]
    (tmp_path / "l.jsonl").write_text('{"movie_key": "k", "film_mood_tags": ["a"]}\n{"movie_key": "k", "film_mood_tags": ["b"]}\n\n{"movie_key": "j"}\n')
    assert {r["movie_key"]: r["tags"] for r in files.read_labels(spark, str(tmp_path / "l.jsonl")).collect()} == {"k": ["b"], "j": []}
    assert files.read_labels(spark, str(tmp_path / "none.jsonl")).count() == 0
    df = spark.createDataFrame([(1, 'x, "y"\nz')], "a int, b string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert files.read_csv(spark, str(tmp_path / "csv"), ["a", "b"]).first()["b"] == 'x, "y"\nz'
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    (tmp_path / "d.json").write_text('{"a": {"b": [1, 2]}}')
    assert files.read_json(spark, str(tmp_path / "d.json")).first()["a"]["b"] == [1, 2]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from quarry.sources import files

    (tmp_path / "f.txt").write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.numbered_lines(spark, str(tmp_path / "f.txt"))
        assert rows.where("value <> concat('line ', line)").count() == 0 and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_runs(tmp_path):
    import datetime

    from quarry.sources import files

    runs, at = files.Runs(str(tmp_path / "runs")), datetime.datetime(2026, 6, 7, 8, 9, 10)
    with pytest.raises(FileNotFoundError):
        runs.latest()
    assert files.new_run(at) == "2026-06-07-0809-nogit" and files.stamp(at) == "2026-06-07T08:09:10Z"
    made = runs.start("2026-06-07-0809-nogit", {"LLM_MODEL": "m"}, now=at, rng_seed=7)
    assert made["rng_seed"] == 7 and made["llm_model"] == "m" and made["timestamps"]["start"] == "2026-06-07T08:09:10Z" and made["timestamps"]["silver_done"] is None
    assert runs.warn(made["run_id"], "low")["warnings"] == ["low"]
    assert runs.done(made["run_id"], "silver_done", at)["timestamps"]["silver_done"] == "2026-06-07T08:09:10Z"
    with pytest.raises(ValueError):
        runs.done(made["run_id"], "lunch")
    for bad in ("../x", "", "a/b", "a..b"):
        with pytest.raises(ValueError):
            runs.folder(bad)
    assert runs.settings(made["run_id"], rules)["RRF_K"] == 15
    runs.ensure("2026-06-08-0000")
    runs.ensure("zzz")
    assert runs.latest() == "2026-06-08-0000"
    files.write_small(str(tmp_path / "runs" / "current_run.txt"), made["run_id"])
    assert runs.latest() == made["run_id"]
    took = {}
    with pytest.raises(KeyError), files.timed("s", took):
        raise KeyError
    assert took["s"] >= 0


def test_snapshot():
    from quarry.sources import files

    assert files.snapshot(rules)["RRF_K"] == 15


def test_plugins(spark, tmp_path):
    df = spark.createDataFrame([(1, "red fox"), (2, None)], "id long, t string")
    got = plugins.embed(df, "t", plugins.HashingEmbedder(8), "id").collect()
    assert len(got) == 2 and sum(x * x for x in got[0]["embedding"]) == pytest.approx(1)

    class Length:
        def score(self, query, texts):
            return [float(len(t)) for t in texts]

    class Model:
        name = "m2"

        def replies(self, prompts):
            if any("boom" in p for p in prompts):
                raise OSError
            return ['{"grade": 2, "confidence": "high", "reason": "fits"}' if "fox" in p else None for p in prompts]

    class Parser:
        def replies(self, texts):
            return ['{"plot_elements": ["heist"]}' for _ in texts]

    todo = spark.createDataFrame([("q", 1, "red fox"), ("q", 2, "sky"), ("q", 3, "blue fox")], "qid string, id long, t string")
    log = spark.createDataFrame([("q", 1, 3, "m2"), ("q", 3, 1, "m1"), ("q", 2, None, "m2")], "qid string, id long, grade int, model string")
    graded = {r["id"]: r for r in plugins.grade(todo, log, Model(), "Text: {t}", {"t": F.col("t")}, F.timestamp_seconds(F.lit(1_700_000_000))).collect()}
    assert {k: (r["grade"], r["confidence"], r["model"]) for k, r in graded.items()} == {2: (None, "low", "m2"), 3: (2, "high", "m2")} and graded[3]["ts"] == "2023-11-14T22:13:20Z"
    failed = plugins.replied(todo.withColumn("t", F.lit("boom")), "t", Model().replies)
    assert failed.where("reply is null").count() == 3
    words = intent.lexicon(spark.createDataFrame([("fear", "afraid")], "category string, word string"))
    asked = spark.createDataFrame([("a quiet story", None)], "text string, mode string")
    assert plugins.parse_intents(asked, words, Parser()).first()["intent"]["plot_elements"] == ["heist"] and plugins.parse_intents(asked, words).first()["intent"]["plot_elements"] == []
    plugins.embed_into(df, "t", plugins.HashingEmbedder(8), "id", str(tmp_path / "vectors"))
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 1
    with pytest.raises(Exception, match="already exists"):
        plugins.embed_into(df, "t", plugins.HashingEmbedder(8), "id", str(tmp_path / "vectors"))

    assert {r["id"]: r["rerank_score"] for r in plugins.rescore(df, "t", "q", Length()).collect()} == {1: 7.0, 2: 0.0}


def test_streaming(spark, tmp_path):
    from quarry.streaming import state

    rows = spark.createDataFrame([(1, 7, "2024-01-01 00:00:01", "a", 1.0), (1, 7, "2024-01-01 00:00:01", "a", 1.0), (2, 7, "2024-01-01 02:00:00", "b", 2.0)], "event_id long, user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sink = str(tmp_path / "out")
    for _ in range(2):
        stream.writeStream.foreachBatch(state.resume_sink(sink, ["event_id"])).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(sink).count() == 2
    q = state.watch_state(stream, ["user_id"], "ts").writeStream.format("memory").queryName("watch").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("watch").first()["watched"] is True
    q = state.activity(state.history(stream, "ts", ["event_id"]), "ts", delay=None).writeStream.format("memory").queryName("act").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("act").count() >= 1


def test_rule_tags_by_literal_and_by_automaton(spark):
    texts = [(1, ["Drama "], "An IDIOTS' tale"), (2, ["War"], None), (3, None, "the heist and the andes"), (4, ["drama", None], "日本語のテキスト"), (5, ["ÉTÉ"], "L'ÉTÉ meurtrier…"), (5, ["war"], "idiot"), (6, [], "")]
    made = [("genre", "drama", ["warm"]), ("genre", "été", ["warm"]), ("keyword", "idiot", ["dark", "funny"]), ("keyword", "diot", ["odd"]), ("keyword", "heist and", ["tense"]), ("keyword", "e an", ["epic"]), ("keyword", "日本", ["far"]), ("keyword", "été m", ["hot"]), ("keyword", "…", ["open"]), ("keyword", None, ["no"]), ("other", "idiot", ["no"])]
    df = spark.createDataFrame(texts, "id long, genres array<string>, text string")

    def plain(rules):
        out = []
        for i, genres, text in texts:
            g = [x.strip().lower() for x in genres or [] if x]
            out.append((i, sorted({t for kind, p, add in rules if p is not None and (kind == "genre" and p in g or kind == "keyword" and p in (text or "").lower()) for t in add})))
        return sorted(out)

    many = made + [("keyword", f"zz{i}", ["no"]) for i in range(20_000)] + [("keyword", "", ["all"])]
    for rules, few, most in ((made, 100, 10), (made, 0, 10**6), (made, 0, 3), (many, 64, 10**6), (many, 64, 7_000)):
        table_ = spark.createDataFrame(rules, "match_type string, pattern string, add array<string>")
        got = labels.rule_tags(df, table_, "id", F.coalesce("genres", F.array().cast("array<string>")), F.col("text"), few, most)
        assert sorted((r["id"], r["tags"]) for r in got.collect()) == plain(rules)


def test_audit_by_list_alone(spark):
    rows = spark.createDataFrame([("a", 1, 0, 1, "low"), ("b", 2, 0, None, "low"), ("b", 3, 9, 1, "high")], "qid string, id long, rank int, grade int, confidence string")
    assert {(r["qid"], r["id"]): r["reasons"] for r in labels.audit(rows, ["a"]).collect()} == {("a", 1): ["qid_in_audit_list", "silver_confidence_low", "silver_grade_1_in_top_5"], ("b", 2): ["silver_confidence_low", "silver_grade_null"]}
    assert {r["id"]: r["reasons"] for r in labels.audit(rows, ["a"], include_rules=False).collect()} == {1: ["qid_in_audit_list"]}


def test_latency_of_large_and_small_groups(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    groups = {"large": rng.random(30_001).round(3), "even": rng.random(8_000), "same": np.ones(5_000), "small": rng.random(7), "one": np.array([2.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "g string, ms double")
    for r in evaluate.latency(df, "g", "ms").collect():
        v = np.sort(groups[r["g"]])
        assert (r["n"], r["median"], r["p95"], r["least"], r["most"]) == (len(v), pytest.approx(np.median(v), abs=1e-6), pytest.approx(v[round(0.95 * (len(v) - 1))], abs=1e-6), pytest.approx(v[0], abs=1e-6), pytest.approx(v[-1], abs=1e-6))


def test_postings_are_counted_where_rows_are_read(spark):
    from quarry.operators.index import postings_of

    def got(df):
        return sorted(tuple(r) for r in postings_of(df, "id", {"t": F.col("t"), "u": F.lit("z")}).select("field", "term", "id", "dl", "tf").collect())

    rows = [(1, "a b a"), (2, None), (3, "b")]
    df = spark.createDataFrame(rows, "id int, t string")
    assert got(df) == [("t", "a", 1, 3, 2), ("t", "b", 1, 3, 1), ("t", "b", 3, 1, 1), ("u", "z", 1, 1, 1), ("u", "z", 2, 1, 1), ("u", "z", 3, 1, 1)]
    assert "Exchange" not in postings_of(df, "id", {"t": F.col("t")})._jdf.queryExecution().executedPlan().toString()
    again = got(spark.createDataFrame([*rows, (1, "a b a")], "id int, t string"))
    assert ("t", "a", 1, 3, 4) in again and ("u", "z", 1, 1, 2) in again and len(again) == 6
