"""Interfaces for models that aren't part of the library, run in Arrow batches, with deterministic stand-ins.

The stand-ins make pipelines runnable without a model. Their scores say nothing about a model's quality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens, utc_stamp
from quarry.operators import intent, labels, render
from quarry.operators.vectors import append_batches


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Scorer(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Grader(Protocol):
    """Replies to grading prompts: JSON texts with grade, confidence and reason. None stands for a failed call."""

    name: str

    def replies(self, prompts: list[str]) -> list[str | None]: ...


class IntentParser(Protocol):
    """Replies to requests: JSON texts with plot_elements, genres_include and genres_exclude. None stands for a failed call."""

    def replies(self, texts: list[str]) -> list[str | None]: ...


class HashingEmbedder:
    """Stand-in: signed hashed words, unit length."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, text: str, embedder: Embedder, id_: str) -> DataFrame:
    """(id, embedding) in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = embedder.embed([x or "" for x in b[text].to_pylist()])
            yield pa.RecordBatch.from_pydict({id_: b[id_], "embedding": pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))})

    return df.select(id_, text).mapInArrow(run, f"{id_} {df.schema[id_].dataType.simpleString()}, embedding array<float>")


def rescore(df: DataFrame, text: str, query: str, scorer: Scorer) -> DataFrame:
    """df with rerank_score by a model."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", rerank_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scorer.score(query, [x or "" for x in b[text].to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "rerank_score"])

    return df.mapInArrow(run, schema)


def replied(df: DataFrame, text: str, replies, out: str = "reply") -> DataFrame:
    """df with a column of a model's replies to its texts, in Arrow batches. A batch whose call raises has null replies: what depends on them falls back."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            try:
                got = replies([x or "" for x in b[text].to_pylist()])
            except Exception:  # a model behind a network may fail in any way
                got = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def parse_intents(texts: DataFrame, words: DataFrame, parser: IntentParser | None = None, text: str = "text", mode: str = "mode") -> DataFrame:
    """texts with `intent`: the lexicon's reading, whose story fields a parser's reply fills if there is one."""
    read = intent.parse_tier1(texts, words, text, mode)
    return read if parser is None else intent.merge_extracted(replied(read, text, parser.replies, "__reply"), "__reply").drop("__reply")


def grade(todo: DataFrame, log: DataFrame, grader: Grader, template: str, fields: dict[str, Column], now: Column, keys: tuple[str, ...] = ("qid", "id")) -> DataFrame:
    """New log rows (keys, grade, confidence, reason, model, ts) for the rows that this model hasn't graded yet; a reply that can't be read is a null grade of low confidence, to be tried again by the next run."""
    left = labels.pending(todo, log, list(keys), grader.name)
    asked = left.select(*keys, render.prompt(template, **fields).alias("__prompt"))
    read = replied(asked, "__prompt", grader.replies, "__reply").withColumn("g", render.grade_reply(F.col("__reply")))
    return read.select(*keys, "g.grade", "g.confidence", "g.reason", F.lit(grader.name).alias("model"), utc_stamp(now).alias("ts"))


def embed_into(df: DataFrame, text: str, embedder: Embedder, id_: str, path: str) -> None:
    """Embeds and writes vectors to a place that must not hold any yet; rows without text are left out."""
    append_batches(embed(df.where(F.coalesce(text, F.lit("")) != ""), text, embedder, id_), path)


def overlap_score(text: Column, terms: list[str] | Column) -> Column:
    """Stand-in for a cross-encoder, as an expression: the share of the query's terms (given, or a column) that the text has."""
    if isinstance(terms, Column):
        own = F.array_distinct(terms)
        return F.when(F.size(own) > 0, F.size(F.array_intersect(own, tokens(text))) / F.size(own)).otherwise(0.0)
    wanted = sorted(set(terms))
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array(*[F.lit(t) for t in wanted]), tokens(text))) / F.lit(float(len(wanted)))
