"""The corpus pipeline: toxicity, language, near duplicates, benchmark passages, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; what it rejects is gone for the next. All stages but the last return the columns of docs.
Empty input gives empty output in every stage; null texts have no letter, so the language stage rejects them. Rows that repeat a doc_id are judged each, but near-dedup keeps or drops an id's rows together; rows without a doc_id are no copies of others. Columns beside doc_id and text pass through, whatever their names; very long texts are read in slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, langid, neardup, pieces, toxicity
from quarry.llm.queries import piece_model
from quarry.session import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the classifier learns from the labelled part of the whole table."""
    return toxicity.reject(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return langid.reject(docs, langid.train(table(spark, sf_dir, "documents")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return neardup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests, with the decoded text's."""
    return pieces.encode_digests(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_pieces),
]

#: SQL can't express the learned stages; tests/llm compare near-dedup and decontamination with brute force, the classifiers with plain versions of their scores, and SentencePiece with the library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
