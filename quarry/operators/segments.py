"""An inverted index that grows: rows are added as segments with statistics of their own, deleted by lists of ids, and merged when the index is read.

A segment is one folder with postings, the ids of its rows, and its counts by term and by field; it never changes. An id that is added again replaces its earlier rows. A row is live if no later segment and no later list of deletions names its id. Counts of the merged index are the segments' counts less those of their dead rows, so that reading doesn't count live postings anew; compact() writes what is live as one segment.
Versions switch at once (sources/versioned.py): a reader keeps the version that it has opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.index import TextIndex, laid, postings_of
from quarry.sources.versioned import Versions


class SegmentedIndex:
    """fields: name -> text column of the rows that are added."""

    def __init__(self, spark: SparkSession, root: str, fields: dict[str, Column]) -> None:
        self.spark, self.fields, self.versions = spark, fields, Versions(spark, root.rstrip("/"))

    def add(self, rows: DataFrame, id_: str = "id") -> int:
        """A version with these rows, one for each id, as a new segment."""
        path = self.versions.folder()
        self._segment(rows.select(F.col(id_).alias("id")), postings_of(rows, id_, self.fields), path)
        return self._log({"segment": path})

    def delete(self, ids: DataFrame, id_: str = "id") -> int:
        """A version without the rows of these ids."""
        path = self.versions.folder()
        ids.select(F.col(id_).alias("id")).distinct().write.parquet(path)
        return self._log({"deleted": path})

    def _log(self, entry: dict) -> int:
        last = self.versions.latest()
        return self.versions.commit(last, {"log": [*self.versions.read(last).get("log", []), entry]})

    def _segment(self, ids: DataFrame, postings: DataFrame, path: str) -> None:
        laid(postings).write.parquet(f"{path}/postings")
        kept = self.spark.read.parquet(f"{path}/postings")
        ids.write.parquet(f"{path}/ids")
        kept.groupBy("field", "term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("total")).write.parquet(f"{path}/counts")

    def _dead(self, log: list[dict], i: int) -> DataFrame | None:
        """Ids of segment i that later entries of the log name."""
        later = [self.spark.read.parquet(f"{e['segment']}/ids" if "segment" in e else e["deleted"]) for e in log[i + 1 :]]
        if not later:
            return None
        named = reduce(DataFrame.unionByName, later).distinct()
        return self.spark.read.parquet(f"{log[i]['segment']}/ids").join(named, "id", "left_semi")

    def _live(self, version: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(ids, postings, counts (field, term, n_docs, total)) of a version."""
        log = self.versions.read(version).get("log", [])
        ids, postings, counts = [], [], []
        for i, e in enumerate(log):
            if "segment" not in e:
                continue
            own = [self.spark.read.parquet(f"{e['segment']}/{n}") for n in ("ids", "postings", "counts")]
            dead = self._dead(log, i)
            if dead is not None:
                gone = own[1].join(dead, "id", "left_semi").groupBy("field", "term").agg((-F.count("*")).alias("n_docs"), (-F.sum("tf")).alias("total"))
                own = [own[0].join(dead, "id", "left_anti"), own[1].join(dead, "id", "left_anti"), own[2].unionByName(gone)]
            ids.append(own[0])
            postings.append(own[1])
            counts.append(own[2])
        if not ids:
            raise ValueError("the index has no segment yet")
        merged = reduce(DataFrame.unionByName, counts).groupBy("field", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("total").alias("total")).where("n_docs > 0")
        return reduce(DataFrame.unionByName, ids), reduce(DataFrame.unionByName, postings), merged

    def index(self, version: int | None = None) -> TextIndex:
        """The index of a version, the latest by default: that of building the live rows at once."""
        ids, postings, counts = self._live(version)
        frame = ids.agg(F.count("*").alias("n")).select(F.explode(F.array(*[F.lit(n) for n in self.fields])).alias("field"), "n")
        lengths = frame.join(counts.groupBy("field").agg(F.sum("total").alias("total")), "field", "left")
        return TextIndex.counted(postings, lengths, counts.select("field", "term", "n_docs"))

    def compact(self) -> int:
        """A version of one segment with what is live now."""
        last = self.versions.latest()
        ids, postings, _ = self._live(last)
        path = self.versions.folder()
        self._segment(ids, postings, path)
        return self.versions.commit(last, {"log": [{"segment": path}]})
