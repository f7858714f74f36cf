"""Removal of lines that recur across documents, with levelled sorted runs of line hashes.

A *run* is a Parquet table ``(h STRUCT<a BIGINT, b BIGINT>, n BIGINT)``: 128-bit hashes of line keys,
hash-partitioned and sorted, each with the number of documents it was seen in. New runs enter level 0;
once a level holds ``fanout`` runs they are merged (counts add up) into one run of the next level, so a
hash lives in a number of runs that is logarithmic in the number of batches. A batch of documents is
first merge-anti-joined with the hashes that the runs already know as frequent; only the rest is added.

All of it is DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fresh_path, hash128, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text split at newlines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def line_hashes(lines: Column, min_chars: int) -> Column:
    """A 128-bit hash for each line; null for keys of fewer than ``min_chars`` code points."""
    keys = F.transform(lines, line_key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, hash128(k)))


class LineRuns:
    """Levelled sorted runs of line hashes in the shared folder."""

    def __init__(self, spark: SparkSession, saturate_at: int, fanout: int = 2):
        self.spark, self.saturate_at, self.fanout = spark, saturate_at, fanout
        self.root = fresh_path(spark, "line-runs")
        self.levels: list[list[DataFrame]] = []
        self._written = 0

    def _write(self, run: DataFrame) -> DataFrame:
        self._written += 1
        path = f"{self.root}/run-{self._written}"
        run.sortWithinPartitions("h").write.parquet(path)
        return self.spark.read.schema("h STRUCT<a: BIGINT, b: BIGINT>, n BIGINT").parquet(path)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("h").agg(F.sum("n").alias("n"))

    def all_runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def saturated(self) -> DataFrame | None:
        """Hashes that a compacted run alone shows as frequent."""
        if runs := [run for level in self.levels[1:] for run in level]:
            return reduce(DataFrame.unionByName, [r.where(F.col("n") >= self.saturate_at).select("h") for r in runs])
        return None

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of ``(h)`` rows, one for each document and distinct line key."""
        counts = batch.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        if (known := self.saturated()) is not None:
            counts = counts.join(known.hint("merge"), "h", "left_anti")
        self._put(0, self._write(counts))

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            self._put(level + 1, merged)

    def frequent(self) -> DataFrame:
        """The hashes found in at least ``saturate_at`` documents of all batches."""
        runs = self.all_runs()
        if not runs:
            return self.spark.createDataFrame([], "h STRUCT<a: BIGINT, b: BIGINT>")
        counts = runs[0] if len(runs) == 1 else self._merged(runs)
        return counts.where(F.col("n") >= self.saturate_at).select("h")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                        min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``(id, n_lines, n_dropped, kept)`` for each row: its text without the lines that recur.

    A line recurs if its key (see ``line_key``) has at least ``min_chars`` code points and is found in at
    least ``min_docs`` rows; it goes from every row. A null or empty text is one empty line, and kept is
    then the empty string. Rows that repeat count as documents of their own, a line that repeats in one row
    counts once. Null ids are allowed; other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    seen = base.select("id", text_key(F.col("text")).alias("t"),
                       F.explode(F.array_distinct(F.filter(line_hashes(lines_of(F.col("text")), min_chars), lambda h: h.isNotNull()))).alias("h"))
    path = fresh_path(spark, "line-hashes")
    seen.withColumn("batch", F.pmod("t", F.lit(batches))).write.partitionBy("batch").parquet(path)
    seen = spark.read.schema(_hash_schema(base)).parquet(path)

    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(seen.where(F.col("batch") == batch).select("h"))

    marked = (seen.join(runs.frequent(), "h", "left_semi")
              .groupBy("id", "t").agg(F.collect_set("h").alias("gone")))
    keyed = base.withColumn("t", text_key(F.col("text")))
    joined = keyed.alias("d").join(marked.alias("m"), F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.t") == F.col("m.t")), "left")
    rows = joined.select(F.col("d.id").alias(id_col), lines_of(F.col("d.text")).alias("lines"), F.col("gone"))
    gone = F.coalesce("gone", F.array().cast("array<struct<a:bigint,b:bigint>>"))
    kept = F.when(F.size(gone) == 0, F.col("lines")).otherwise(
        F.transform(F.filter(F.arrays_zip(F.col("lines").alias("line"), line_hashes(F.col("lines"), min_chars).alias("h")),
                             lambda x: x["h"].isNull() | ~F.array_contains(gone, x["h"])), lambda x: x["line"]))
    return (rows.withColumn("kept_lines", kept)
            .select(id_col, F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
                    F.array_join("kept_lines", "\n").alias("kept")))


def _hash_schema(base: DataFrame):
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    h = StructType([StructField("a", LongType()), StructField("b", LongType())])
    return StructType([StructField("id", base.schema["id"].dataType), StructField("t", LongType()), StructField("h", h), StructField("batch", IntegerType())])
