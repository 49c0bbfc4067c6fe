"""Streams over the event table: event-time windows, sessions, deduplication and joins of streams.

A stream reads the table's files, keeps its state within a watermark, and appends to
Parquet in the shared folder with its checkpoint beside it, so that it can go on after a
failure and each row is written once. Windows still open at the end of input aren't
written, as append mode has it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import fresh_path

DELAY = "1 hour"


def source(spark: SparkSession, sf_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Events as a stream. Watermarks need an instant, so ts is read as one in the session's zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as the stream reader takes folders and patterns but no single file
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def appended(stream: DataFrame, path: str | None = None) -> DataFrame:
    """All that the stream appends from what is there now. With the path of an earlier run it goes on where that one ended."""
    spark = stream.sparkSession
    path = path or fresh_path(spark, "stream")
    out = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state")
    out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _each_batch(stream: DataFrame, mode: str, path: str) -> DataFrame:
    """Each batch's rows as a folder of its number, written over when a batch comes again after a failure."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def completed(stream: DataFrame, path: str | None = None) -> DataFrame:
    """The whole result as the last batch leaves it (complete mode)."""
    rows = _each_batch(stream, "complete", path or fresh_path(stream.sparkSession, "stream"))
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(F.broadcast(last), F.col("batch") == F.col("last")).drop("batch", "last")


def updated(stream: DataFrame, keys: list[str], path: str | None = None) -> DataFrame:
    """The latest row of each key (update mode: a batch holds the rows that it changed)."""
    rows = _each_batch(stream, "update", path or fresh_path(stream.sparkSession, "stream"))
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("row"))
    return newest.select(*keys, "row.*").select(*[c for c in rows.columns if c != "batch"])


def in_memory(stream: DataFrame) -> DataFrame:
    """The whole result as a table that the driver holds: for results of a known few rows."""
    name = f"stream_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", fresh_path(stream.sparkSession, "stream")).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def wall(time: str) -> Column:
    """Back from an instant to what the clock showed."""
    return F.col(time).cast("timestamp_ntz")


def tumbling(events: DataFrame, size: str = "1 hour") -> DataFrame:
    counts = events.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(wall("window.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    counts = events.groupBy(F.window("ts", size, slide)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(wall("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """A user's sessions: rows less than the gap apart."""
    found = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", wall("session_window.start").alias("start"), wall("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame) -> DataFrame:
    """The first of the rows of an event_id within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", wall("ts").alias("ts"))


def followed(first: DataFrame, second: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Pairs of one user's rows of two streams, the second after the first by at most ``within``; the bound lets state go."""
    a = first.select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("at"))
    b = second.select(F.col("user_id").alias("same"), F.col("event_id").alias("b"), F.col("ts").alias("to"))
    return a.join(b, F.expr(f"user_id = same AND to > at AND to <= at + INTERVAL {within}")).select("user_id", "a", "b")
