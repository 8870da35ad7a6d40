"""Append-only logs as streams: late and repeated rows, windows with watermark, and stream-static joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """A folder of log files as a stream with a fixed schema."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def _marked(events: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermark on a stream; times without zone are taken in the session's."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay) if events.isStreaming else events


def first_seen(events: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark; state older than ``delay`` is dropped."""
    return _marked(events, time, delay).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, time: str, width: str, delay: str, by: list[str], value: str = "value", slide: str | None = None) -> DataFrame:
    """(window_start, by, n, n_errors, total): tumbling windows, or sliding ones with ``slide``; rows later than ``delay`` are dropped in a stream."""
    marked = _marked(events, time, delay)
    grouped = marked.groupBy(F.window(time, width, slide), *by) if slide else marked.groupBy(F.window(time, width), *by)
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), *by, "n", "n_errors", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, time: str, gap: str, delay: str, by: str) -> DataFrame:
    """(by, session_start, session_end, n): activity separated by pauses of at least ``gap``."""
    marked = _marked(events, time, delay)
    found = marked.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return found.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop, into a memory table; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(stream: DataFrame, folder: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Append a stream to Parquet files, exactly once for each micro-batch."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    query = (writer.partitionBy(partition) if partition else writer).start()
    query.awaitTermination()
    return query
