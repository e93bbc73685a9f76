"""Block-bounded retrieval and pipelines over query tables against scoring everything and the pipelines for one query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import fusion, vectors
from quarry.operators.blocks import BlockIndex, VectorBlocks
from quarry.operators.index import TextIndex, top
from quarry.plans import batch, pipelines
from quarry.plans import queries as own
from quarry.plans.plugins import overlap_score
from quarry.session import stored, table

SF = "/root/testdata/sf0.001"


def test_text_blocks_skip_and_equal_full_scoring(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"group{i // 50} " + " ".join(f"w{x}" for x in rng.zipf(1.5, 12) if x < 300) + (" rare" if i in (7, 8, 450) else ""), int(i // 50)) for i in range(600)] + [(1000, None, 3), (1001, "", 3), (1002, "rare rare common", 99)]
    df = spark.createDataFrame(rows, "id long, body string, part int")
    index = TextIndex.build(df, "id", {"body": F.col("body")}).stored()
    blocks = BlockIndex.build(index, df.select("id", "part"), ["part", "id"], {"body": 1.0}, size=16)
    asked = {0: ["w1", "w2", "rar"], 1: ["w1", "w1", "group3"], 2: ["nothing"], 3: ["w1"]}
    terms = stored(spark.createDataFrame([(q, t, ts.count(t)) for q, ts in asked.items() for t in set(ts)], "qid int, term string, qtf long"))
    for k in (5, 1000):
        hits, read = blocks.search(terms, k)
        read = {r["qid"]: (r["read"], r["blocks"]) for r in read.collect()}
        for q, ts in asked.items():
            want = [(r["id"], round(r["s"], 6)) for r in top(index.search(ts, {"body": 1.0}).withColumnRenamed("bm25_score", "s"), "s", "id", k, "r").collect()]
            got = [(r["id"], round(r["bm25_score"], 6)) for r in top(hits.where(F.col("qid") == q).select("id", "bm25_score"), "bm25_score", "id", k, "r").collect()]
            assert got == want
        assert 2 not in read and all(a <= b for a, b in read.values())
    hits, read = blocks.search(terms, 5)
    assert any(r["read"] < r["blocks"] for r in read.collect())


def test_a_filter_and_a_key_do_not_lose_rows(spark):
    rows = [(i, "x " * (1 + i % 7) if i < 200 else "other", i % 5) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, body string, part int")
    index = TextIndex.build(df, "id", {"body": F.col("body")}).stored()
    blocks = BlockIndex.build(index, df.select("id", "part"), ["id"], {"body": 1.0}, size=8)
    terms = stored(spark.createDataFrame([(0, "x", 1)], "qid int, term string, qtf long"))
    hits, _ = blocks.search(terms, 5, "part", lambda r: r.where("id % 2 = 1"))
    score = {r["id"]: r["bm25_score"] for r in index.search(["x"], {"body": 1.0}).where("id % 2 = 1").collect()}
    best = {r["part"]: round(r["s"], 6) for r in hits.groupBy("part").agg(F.max("bm25_score").alias("s")).collect()}
    assert best == {p: round(max(s for i, s in score.items() if i % 5 == p), 6) for p in range(5)}


@pytest.mark.parametrize("size", [4, 64])
def test_vector_blocks_skip_and_equal_full_scan(spark, size):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(8, 6))
    v = np.concatenate([middle[i % 8] + 0.02 * rng.normal(size=6) for i in range(400)]).reshape(400, 6)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[5] = v[13]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 3 if i % 11 else None) for i, r in enumerate(v)] + [(900, None, 1)], "vec_id long, embedding array<float>, label int")
    blocks = VectorBlocks.build(df, attributes=("label",), pivots=8, size=size)
    asked = stored(spark.createDataFrame([(q, [float(x) for x in v[q]], lo, hi) for q, lo, hi in ((5, None, None), (13, None, 1), (2, 1, None), (9, 5, 7))], "qid int, q array<double>, label_min int, label_max int"))
    for k in (7, 500):
        got, read = blocks.search(asked, k)
        got = got.collect()
        for r in asked.collect():
            keep = (F.col("label") >= r["label_min"]) if r["label_min"] is not None else F.lit(True)
            keep &= (F.col("label") <= r["label_max"]) if r["label_max"] is not None else F.lit(True)
            want = [(x["id"], round(x["semantic_score"], 9), x["semantic_rank"]) for x in vectors.search(df.where("embedding is not null"), r["q"], k, keep).collect()]
            assert sorted((x["id"], round(x["semantic_score"], 9), x["semantic_rank"]) for x in got if x["qid"] == r["qid"]) == sorted(want)
        if k == 7 and size == 4:
            assert all(r["read"] < r["blocks"] / 2 for r in read.where("qid <> 9").collect())


def test_batch_equals_single_queries(spark):
    src = own.sources(spark, SF)
    many = own.batch_sources(spark, SF)
    asked = [own.ASKED, own.SAD, own.FILTERED]
    v = [own.vector(spark, SF, i) for i in (0, 1)]
    q = spark.createDataFrame([(i, a, v[0], v[1]) for i, a in enumerate(asked)] + [(3, "  ", v[0], None), (4, None, None, None)], "qid int, query string, q array<float>, q2 array<float>")
    dark = fusion.is_dark(F.col("overview"), F.col("genres"), phrases=own.WORDS)
    got = batch.run(many, batch.readings(q), 20, overlap_score, dark=dark).collect()
    show = lambda rows: sorted((r["pos"], r["id"], r["movie_key"], round(r["score"], 7), r["dark"], r["explanation"]) for r in rows)
    for i, a in enumerate(asked[:2]):
        for mode, imagine in (("hybrid", None), ("advanced", lambda q: "imagined")):
            want = own.run_hybrid(spark, SF, a, 20, imagine).withColumnRenamed("final_score", "score").collect()
            assert show(want) == show(r for r in got if (r["qid"], r["mode"]) == (i, mode))
    want = [(r["id"], round(r["semantic_score"], 9)) for r in pipelines.basic(src, v[0], 20).orderBy("semantic_rank").collect()]
    assert want == [(r["id"], round(r["score"], 9)) for r in sorted((r for r in got if (r["qid"], r["mode"]) == (0, "basic")), key=lambda r: r["pos"])]
    assert {r["mode"] for r in got if r["qid"] == 3} == {"basic"} and not [r for r in got if r["qid"] == 4]
    assert {r["dark"] for r in got if r["qid"] == 0} == {False}


def test_scores_below_what_is_known_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, f"w{i} " + "x " * (1 + i % 7) * (i % 3 == 0) + "y" * (i % 4 == 1)) for i in range(60)], "id long, body string")
    index = TextIndex.build(df, "id", {"body": F.col("body")}).stored()
    blocks = BlockIndex.build(index, df.select("id"), ["id"], {"body": 1.0}, size=8)
    terms = stored(spark.createDataFrame([(0, "x", 1), (1, "x", 2), (1, "y", 1)], "qid int, term string, qtf long"))
    asked = blocks.bounds(terms).select("qid", "block")
    every = {(r["qid"], r["id"]): r["bm25_score"] for r in blocks.scored(terms, asked).collect()}
    assert len(every) == 50
    cut = sorted(s for (q, _), s in every.items() if q == 1)[-5]
    some = blocks.scored(terms, asked, spark.createDataFrame([(1, cut)], "qid int, least double")).collect()
    assert {(r["qid"], r["id"]) for r in some} == {x for x, s in every.items() if x[0] == 0 or s >= cut}
    vecs = spark.createDataFrame([(i, [1.0, i / 50]) for i in range(50)], "vec_id long, embedding array<double>")
    near = VectorBlocks.build(vecs, size=8)
    q = stored(spark.createDataFrame([(0, [0.0, 1.0])], "qid int, q array<double>"))
    found = near.scored(q, near.bounds(q).select("qid", "block"), 8, spark.createDataFrame([(0, 0.9)], "qid int, least double"))
    assert sorted(r["id"] for r in found.collect()) == [45, 46, 47, 48, 49]


def test_blocks_of_rows_equal_an_index_of_them(spark, monkeypatch):
    """Packed where rows lie: blocks that cross Arrow batches, rows without text, fields that lack; and the queries' blocks make no postings beside them."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 20) if x < 200), None if i % 9 == 0 else f"w{i % 4} t{i % 50}", i % 3) for i in range(500)] + [(900, None, None, 1), (901, "", "w1", 0), (902, "w1 " * 400, "w1 w1", 2)]
    df = spark.createDataFrame(rows, "id long, body string, head string, part int")
    texts, boosts = {"head": F.col("head"), "body": F.col("body"), "none": F.lit("")}, {"head": 2.5, "body": 1.0, "none": 1.0}
    index = TextIndex.build(df, "id", texts).stored()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        blocks = BlockIndex.of(df, "id", texts, {"part": F.col("part")}, ["part", "id"], boosts, size=16)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    asked = {0: ["w1", "w2", "t7"], 1: ["w1", "w1", "w3", "t11"], 2: ["nothing"], 3: ["w3"]}
    terms = stored(spark.createDataFrame([(q, t, ts.count(t)) for q, ts in asked.items() for t in set(ts)], "qid int, term string, qtf long"))
    assert blocks.rows.count() == len(rows) and blocks.impacts.groupBy("term", "block").count().where("count > 1").isEmpty()
    for k in (5, 1000):
        hits, read = blocks.search(terms, k)
        hits, read = hits.collect(), read.collect()
        for q, ts in asked.items():
            want = [(r["id"], round(r["s"], 6)) for r in top(index.search(ts, boosts).withColumnRenamed("bm25_score", "s"), "s", "id", k, "r").collect()]
            got = sorted(((r["id"], round(r["bm25_score"], 6)) for r in hits if r["qid"] == q), key=lambda x: (-x[1], x[0]))[:k]
            assert sorted(got) == sorted(want)
        assert k > 5 or any(r["read"] < r["blocks"] for r in read)
    few = blocks.search(terms, 5)[0].where("qid = 3").collect()  # what can't be among the best isn't passed on
    assert 5 <= len(few) < sum(r["qid"] == 3 for r in hits)
    bound = {(r["qid"], r["block"]): r["bound"] for r in blocks.bounds(terms).collect()}
    of = {r["id"]: r["block"] for r in blocks.rows.collect()}
    assert all(round(r["bm25_score"] * 1e9) <= bound[r["qid"], of[r["id"]]] for r in hits)
    monkeypatch.setattr(own, "_batch_sources", {})
    monkeypatch.setattr(own, "index", lambda *_: 1 / 0)
    assert own.bm25_blocks(spark, SF).count() == 20
