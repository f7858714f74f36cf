"""Streams: the same text Columns over unbounded sources, and event windows.

Text rules keep no state, so a stream of documents runs through them as a table does. Re-delivered documents go by a watermark;
pages that arrive one by one are put together when their document is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def token_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens)`` of each document, without state."""
    return docs.select("doc_id", F.size(T.tokens("text")).cast("long").alias("n_tokens"))


def token_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.tokenized("text")).alias("token_no", "token")).select("doc_id", "token_no", "token.text", "token.whitespace")


def once(docs: DataFrame, time_col: str, late: str = "10 minutes") -> DataFrame:
    """Documents without those delivered again within the watermark."""
    return docs.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["doc_id"])


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """``(start, event_type, n, total)`` of tumbling or sliding windows; late events are dropped by the watermark if one is given."""
    df = events.withWatermark("ts", late) if late else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return df.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """``(user_id, start, end, n)``: runs of a user's events with gaps below the limit."""
    df = events.withWatermark("ts", late) if late else events
    return df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into Parquet files, and waits."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    query.awaitTermination()
