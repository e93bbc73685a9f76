"""Merged tables, growing indexes and bucketed joins against the batch forms of the same."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from quarry.operators import store
from quarry.operators.index import TextIndex
from quarry.operators.segments import SegmentedIndex
from quarry.session import checkpoint_root
from quarry.sources.versioned import Conflict, MergedTable, Versions, bucketed


@pytest.fixture
def root(spark):
    return f"{checkpoint_root(spark)}/test-{uuid.uuid4().hex}"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_merged_table_equals_the_batch_upsert(spark, root):
    schema = "key string, id int, title string, at int"
    old = spark.createDataFrame([("a", 1, "A", 1), ("b", 2, "B", 2), (None, 3, "N", 3)], schema)
    t = MergedTable(spark, root, ["key"], ("id",))
    assert t.create(old) == 1
    new = [("a", 9, "A2", 5), ("c", 4, "C", 6), ("a", 10, "A3", 7), (None, 11, "N2", 8)]
    t.merge(spark.createDataFrame(new, schema), F.col("at"))
    want = store.upsert(old, spark.createDataFrame(new, schema), "key", "at", ("id",))
    assert rows(t.read(), "key", "id", "title", "at") == rows(want, "key", "id", "title", "at")
    t.merge(spark.createDataFrame([("a", 0, "", 9), ("b", 0, "", 9), ("a", 20, "A4", 10)], schema), F.col("at"), F.col("title") == "")
    assert rows(t.read()) == [("a", 20, "A4", 10), ("c", 4, "C", 6), (None, 3, "N2", 8)]  # a came back as a new row
    before = rows(t.read())
    assert rows(t.read(1)) == rows(old)  # old versions stay
    t.compact()
    assert rows(t.read()) == before and not t.versions.read()["deltas"]
    assert t.versions.vacuum() == 3 and rows(t.read()) == before
    t.clear()
    assert t.read().count() == 0 and t.read().columns == old.columns


def test_a_lost_or_late_writer_leaves_the_version(spark, root, monkeypatch):
    schema = "key string, v int"
    t = MergedTable(spark, root, ["key"])
    t.create(spark.createDataFrame([("a", 1)], schema))
    change = spark.createDataFrame([("a", 2)], schema)

    def lost(self, after, content):
        raise OSError("the writer is gone")

    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lost)
        with pytest.raises(OSError):
            t.merge(change, F.lit(1))
    assert t.versions.latest() == 1 and rows(t.read()) == [("a", 1)]
    with pytest.raises(Exception):  # data that can't be written
        t.merge(change.withColumn("v", F.raise_error("bad").cast("int")), F.lit(1))
    assert rows(t.read()) == [("a", 1)]
    t.merge(change, F.lit(1))
    with pytest.raises(Conflict):
        t.versions.commit(1, {"base": "x", "deltas": []})
    assert rows(t.read()) == [("a", 2)] and not [f for f in os.listdir(root.removeprefix("file://") + "/versions") if f.startswith("draft")]


def test_growing_index_equals_a_rebuild(spark, root):
    schema = "id long, title string, body string"
    first = [(1, "one", "the cat sat"), (2, "two", "the dog ran the dog"), (3, None, ""), (4, "four", "cats and dogs")]
    more = [(5, "five", "a new dog"), (2, "two again", "no animal here"), (6, "six", "the the the")]
    fields = {"title": F.col("title"), "body": F.col("body")}
    grown = SegmentedIndex(spark, root, fields)
    with pytest.raises(ValueError):
        grown.index()
    grown.add(spark.createDataFrame(first, schema))
    grown.add(spark.createDataFrame(more, schema))
    grown.delete(spark.createDataFrame([(1,), (77,)], "id long"))
    live = {r[0]: r for r in [*first, *more]}
    live.pop(1)

    def same(index, rows_):
        want = TextIndex.build(spark.createDataFrame(rows_, schema), "id", fields)
        assert rows(index.postings, "field", "term", "id", "tf", "dl") == rows(want.postings, "field", "term", "id", "tf", "dl")
        assert rows(index.fields, "field", "n", "avgdl") == rows(want.fields, "field", "n", "avgdl")
        near = lambda i: [(f, t, n, round(x, 9)) for f, t, n, x in rows(i.terms, "field", "term", "n_docs", "idf")]
        assert near(index) == near(want)
        found = lambda i: [(r[0], round(r[1], 9)) for r in rows(i.search(["dog", "the", "two"], {"title": 1.0, "body": 2.0}), "id", "bm25_score")]
        assert found(index) == found(want)

    same(grown.index(), list(live.values()))
    same(grown.index(1), first)
    grown.compact()
    same(grown.index(), list(live.values()))
    grown.add(spark.createDataFrame([(1, "back", "the cat")], schema))
    same(grown.index(), [*live.values(), (1, "back", "the cat")])


def test_bucketed_tables_join_without_a_shuffle(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        name = uuid.uuid4().hex[:8]
        catalog = bucketed(spark.range(1000).withColumn("title", F.concat(F.lit("t"), "id")), f"catalog_{name}", ["id"], 4)
        labels = bucketed(spark.range(0, 1000, 3).withColumn("grade", F.col("id") % 4), f"labels_{name}", ["id"], 4)
        joined = catalog.join(labels, "id", "left").groupBy("id").agg(F.max("grade").alias("grade"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.where("grade is not null").count() == 334
        assert "Exchange" in spark.range(10).join(labels, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        spark.sql(f"drop table if exists catalog_{name}")
        spark.sql(f"drop table if exists labels_{name}")
