"""The registered queries of the subpackage: thin wrappers that apply an operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import ball_kmeans, decontam, fingerprint, langid, neardup, pieces, quality, quality_rules, resampling, suffix_tree, token_files, toxicity, url_filter
from quarry.session import table


def piece_model(path: str | None = None) -> pieces.Model:
    """The SentencePiece model at path; by default the public one that is installed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.read_model(path)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), piece_model())


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.read(spark, token_files.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.train(documents))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.report(table(spark, sf_dir, "embeddings")).drop("compared")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_files": op2_token_files,
    "op3_language_id": op3_language_id,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_fingerprints": op8_fingerprints,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_url_filter": op10_url_filter,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_quality_rules": op12_quality_rules,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES: dict[str, str] = {"op10_url_filter": url_filter.ORACLE, "op11_ball_kmeans": ball_kmeans.ORACLE, "op13_importance_resampling": resampling.ORACLE, "op4_minhash_near_dedup": neardup.ORACLE}
