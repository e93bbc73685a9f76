"""Sheets of rows that a person grades again: building one from several batches, its manifest, and the check of a filled one against what was handed out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.labels import top_modes

#: fixed values: who may have graded a row again
PROVENANCES = ("ai_draft", "human_reviewed_ai_assisted", "null_parse_error_fixed")
ROW = ("qid", "id", "query", "title", "silver_grade", "silver_confidence", "silver_reason", "in_top_5_of", "flag_reasons", "gold_grade", "gold_notes", "batch", "batch_purpose")


def union_batch(ranked: DataFrame, details: DataFrame, batch: int, purpose: str, reason: str, qids: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    """Rows of a sheet: what some mode has in its top k of these queries (all without a list), with details (qid, id, query, title, silver_grade, silver_confidence, silver_reason)."""
    rows = ranked.where(F.col("qid").isin(*qids)) if qids else ranked
    found = top_modes(rows, k).withColumnRenamed("modes", "in_top_5_of")
    flags = F.concat(F.array(F.lit(reason)), F.transform("in_top_5_of", lambda m: F.concat(F.lit("top_5_"), m)))
    out = found.join(details, ["qid", "id"]).withColumns({"flag_reasons": flags, "gold_grade": F.lit(None).cast("int"), "gold_notes": F.lit(None).cast("string"), "batch": F.lit(batch), "batch_purpose": F.lit(purpose)})
    return out.select(*ROW)


def sheet(batches: list[DataFrame]) -> DataFrame:
    """All batches with `line`, the row's number by batch, query and id. A sheet is what a person reads: small."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out.withColumn("line", F.row_number().over(Window.orderBy("batch", "qid", "id")))


def manifest(rows: DataFrame) -> DataFrame:
    """(kind, key, n, grade): rows in all, by batch and by query, and each row's silver grade; a key that occurs twice has n = 2."""
    total = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("").alias("key"), "n", F.lit(None).cast("int").alias("grade"))
    by = lambda c: rows.groupBy(F.col(c).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "key", "n", F.lit(None).cast("int").alias("grade"))
    each = rows.groupBy(F.concat_ws(":", "qid", F.col("id").cast("string")).alias("key")).agg(F.count("*").alias("n"), F.first("silver_grade").alias("grade")).select(F.lit("row").alias("kind"), "key", "n", "grade")
    return total.unionByName(by("batch")).unionByName(by("qid")).unionByName(each)


def check(filled: DataFrame, expected: DataFrame, fixed: tuple[str, ...] = ("query", "title", "silver_grade", "silver_confidence", "silver_reason", "batch", "batch_purpose")) -> DataFrame:
    """(line, qid, id, problems) of a filled sheet against the one that was handed out, line by line: missing and added lines, another row in a line, changed fields that aren't the grader's, grades outside 0 to 3, changed grades without notes, unknown provenance."""
    e, f = expected.alias("e"), filled.alias("f")
    both = e.join(f, F.col("e.line") == F.col("f.line"), "full_outer")
    c = F.col
    here = c("e.line").isNotNull() & c("f.line").isNotNull()
    same = here & c("e.qid").eqNullSafe(c("f.qid")) & c("e.id").eqNullSafe(c("f.id"))
    told = c("f.label_provenance") if "label_provenance" in filled.columns else F.lit(None).cast("string")
    problems = [
        F.when(c("f.line").isNull(), "missing row").when(c("e.line").isNull(), "added row"), F.when(here & ~same, F.concat(F.lit("expected "), c("e.qid"), F.lit(":"), c("e.id").cast("string"))),
        *[F.when(same & ~c(f"e.{n}").eqNullSafe(c(f"f.{n}")), F.lit(f"{n} differs")) for n in fixed],
        F.when(same & c("f.gold_grade").isNotNull() & ~c("f.gold_grade").between(0, 3), "gold_grade must be one of 0, 1, 2, 3"),
        F.when(same & c("f.gold_grade").isNotNull() & ~c("f.gold_grade").eqNullSafe(c("f.silver_grade")) & (F.trim(F.coalesce("f.gold_notes", F.lit(""))) == ""), "gold_notes must be given when the grade differs"),
        F.when(same & told.isNotNull() & ~told.isin(*PROVENANCES), "label_provenance is unknown"),
    ]
    out = both.select(F.coalesce("e.line", "f.line").alias("line"), F.coalesce("f.qid", "e.qid").alias("qid"), F.coalesce("f.id", "e.id").alias("id"), F.array_compact(F.array(*problems)).alias("problems"))
    return out.where(F.size("problems") > 0)
