"""Inverted index and field-weighted BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import rules
from quarry.functions.text import DIGITS, stem, tokens
from quarry.session import scratch, stored


def postings_of(df: DataFrame, id_: str, fields: dict[str, Column]) -> DataFrame:
    """(field, term, id, dl, tf) of the given text of each field. A row's terms are counted where it is read; only ids that repeat meet by a shuffle."""
    named = df.select(F.col(id_).alias("id"), *[tokens(c).alias(n) for n, c in fields.items()])
    schema = f"field string, term string, id {named.schema['id'].dataType.simpleString()}, dl int, tf long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.schema.names[1:]:
                size = batch[name].value_lengths().fill_null(0).to_numpy()
                words = batch[name].flatten().dictionary_encode()
                if not len(words):
                    continue
                kinds = len(words.dictionary)
                key, tf = np.unique(np.repeat(np.arange(len(size)), size) * kinds + words.indices.to_numpy(), return_counts=True)
                for i in range(0, len(key), 1 << 16):
                    row, code = np.divmod(key[i : i + (1 << 16)], kinds)
                    yield pa.RecordBatch.from_pydict({"field": pa.array([name]).take(pa.array(np.zeros(len(row), np.int64))), "term": words.dictionary.take(pa.array(code)), "id": batch["id"].take(pa.array(row)), "dl": pa.array(size[row].astype(np.int32)), "tf": pa.array(tf[i : i + (1 << 16)])})

    postings = named.mapInArrow(run, schema)
    if df.groupBy(F.col(id_)).count().where("count > 1").isEmpty():
        return postings
    return postings.groupBy("field", "term", "id", "dl").agg(F.sum("tf").alias("tf"))


SPREAD = 16  # tasks of a frequent term


def laid(postings: DataFrame) -> DataFrame:
    """Postings as they are stored: dealt by term, a frequent term to several tasks, and sorted by term, so that a query's terms prune pages."""
    return postings.repartition("term", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("term")


class TextIndex:
    """postings(field, term, id, tf, dl), fields(field, n, avgdl), terms(field, term, n_docs, idf). Statistics are global: filters at query time don't change them."""

    def __init__(self, postings: DataFrame, fields: DataFrame, terms: DataFrame) -> None:
        self.postings, self.fields, self.terms = postings, fields, terms

    @staticmethod
    def build(df: DataFrame, id_: str, fields: dict[str, Column]) -> TextIndex:
        """Indexes the given text of each field. Texts are tokenised once, for the postings, which are stored; all statistics come from these and from the number of rows."""
        postings = stored(laid(postings_of(df, id_, fields)))
        frame = df.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(n) for n in fields])).alias("field"), "n")
        lengths = frame.join(postings.groupBy("field").agg(F.sum("tf").alias("total")), "field", "left")
        return TextIndex.counted(postings, lengths, postings.groupBy("field", "term").agg(F.count("*").alias("n_docs")))

    @staticmethod
    def counted(postings: DataFrame, lengths: DataFrame, counts: DataFrame) -> TextIndex:
        """An index from its counts. lengths: field, n (rows), total (of their tokens); counts: field, term, n_docs."""
        stats = lengths.where("n > 0").select("field", "n", (F.coalesce("total", F.lit(0)) / F.col("n")).alias("avgdl"))
        terms = counts.join(F.broadcast(stats.select("field", "n")), "field")
        terms = terms.withColumn("raw", F.log(F.col("n") - F.col("n_docs") + 0.5) - F.log(F.col("n_docs") + 0.5))
        floor = terms.groupBy("field").agg((F.lit(rules.EPSILON) * F.avg("raw")).alias("floor"))
        terms = terms.join(F.broadcast(floor), "field").select("field", "term", "n_docs", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
        return TextIndex(postings, stats, terms)

    def write(self, path: str) -> None:
        """Postings are laid() out, terms sorted: a query's terms prune what is read, and a frequent term fills several tasks."""
        laid(self.postings).write.parquet(f"{path}/postings")
        self.fields.write.parquet(f"{path}/fields")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")

    @staticmethod
    def read(spark: SparkSession, path: str) -> TextIndex:
        return TextIndex(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "fields", "terms")))

    def stored(self) -> TextIndex:
        """The index as tables in the shared scratch folder, to be queried many times. Postings that build() has stored there are not written again."""
        if hasattr(self.postings, "scratch_path"):
            return TextIndex(self.postings, stored(self.fields), stored(self.terms.repartitionByRange("term").sortWithinPartitions("term")))
        path = scratch(self.postings.sparkSession)
        self.write(path)
        return TextIndex.read(self.postings.sparkSession, path)

    def search(self, terms: list[str], boosts: dict[str, float] | None = None, k1: float = rules.K1, b: float = rules.B) -> DataFrame:
        """(id, bm25_score) of documents that score above 0. A term that is asked twice counts twice."""
        spark = self.postings.sparkSession
        boosts = boosts or {f: 1.0 for f in rules.FIELD_BOOSTS}
        counts: dict[str, int] = {}
        for t in terms:
            counts[t] = counts.get(t, 0) + 1
        if not counts:
            return self.postings.select("id", F.lit(0.0).alias("bm25_score")).limit(0)
        wanted = list(counts)
        query = F.broadcast(spark.createDataFrame(list(counts.items()), "term string, qtf long"))
        boost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("field")), F.lit(0.0))
        hits = self.postings.where(F.col("term").isin(wanted)).join(query, "term").join(F.broadcast(self.terms.where(F.col("term").isin(wanted))), ["field", "term"]).join(F.broadcast(self.fields), "field")
        part = boost * F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return hits.groupBy("id").agg(F.sum(part).alias("bm25_score")).where("bm25_score > 0")


def expanded(text: Column) -> Column:
    """Stemmed words of a query in order, then of each synonym group that has stems enough among them the group's other stems by name."""
    own, out = tokens(text), []
    for least, words in rules.SYNONYMS:
        group = F.array_sort(F.array_distinct(F.transform(F.array(*[F.lit(w) for w in sorted(words)]), stem)))
        out.append(F.when(F.size(F.array_intersect(own, group)) >= least, F.array_except(group, own)).otherwise(F.array().cast("array<string>")))
    return F.concat(own, *out)


def query_terms(spark: SparkSession, text: str, expand: bool = True) -> list[str]:
    """Terms of one query on the driver: a projection of one literal row, which Spark folds without a job."""
    c = F.lit(text or "")
    return list(spark.sql("select 1").select(expanded(c) if expand else tokens(c)).first()[0])


def top(df: DataFrame, score: str, key: str, k: int, rank: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The k best rows (of each `by`) by score, then key, with contiguous ranks from 0. Only k rows of a task meet in one task."""
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc(score), key)
        return df.withColumn(score, F.round(score, DIGITS)).withColumn(rank, F.row_number().over(w) - 1).where(F.col(rank) < k)
    best = df.withColumn(score, F.round(score, DIGITS)).orderBy(F.desc(score), key).limit(k)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(F.desc(score), key)) - 1)
