"""Structured Streaming jobs: latest prices, late snapshots, price changes, sessions, windows, settlement.

Each takes a streaming (or, for a backfill, a batch) frame and returns one; ``run_once``
drains what there is (``availableNow``) into a table in the shared folder, exactly once by
checkpoint and batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.scratch import scratch


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over a Parquet file or folder with its own schema. The source takes folders
    and patterns only, so the last letter becomes a pattern that matches itself."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def run_once(stream: DataFrame, mode: str, label: str, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drain the stream and read the result. Complete mode replaces the table with each
    batch; append mode adds a folder named by the batch id, so that a repeated batch
    overwrites itself."""
    spark = stream.sparkSession
    out, state = scratch(spark, label), scratch(spark, f"{label}-state")
    schema: list = []

    def sink(batch: DataFrame, number: int) -> None:
        batch = each(batch) if each else batch
        schema[:] = [batch.schema]
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    if not schema:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(schema[0]).parquet(out) if mode == "complete" else spark.read.schema(schema[0]).option("basePath", out).parquet(f"{out}/batch=*")


def latest_price(ticks: DataFrame, keys: list[str], value: str, time: str, tie: str) -> DataFrame:
    """The newest value of each key: an aggregation whose state is a row a key."""
    return ticks.groupBy(*keys).agg(F.max_by(value, F.struct(time, tie)).alias("latest"), F.count("*").alias("ticks"))


def on_time(snapshots: DataFrame, kickoffs: DataFrame, key: str, captured: str, kickoff: str) -> DataFrame:
    """The late rule: a snapshot counts only strictly before its own match's kickoff, whatever
    the watermark. A stream-static join, so no state is kept."""
    return snapshots.join(kickoffs, key).where(F.col(captured) < F.col(kickoff))


def without_repeats(ticks: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Identical prices once within the watermark; state is bounded by ``delay``."""
    return ticks.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if ticks.isStreaming else ticks.dropDuplicates(keys)


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, delay: str | None = None) -> DataFrame:
    """Event chains with gaps of at most ``gap``."""
    watched = events.withWatermark(time, delay) if delay else events
    return watched.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n"))


def windows(events: DataFrame, keys: list[str], time: str, width: str, delay: str | None = None) -> DataFrame:
    watched = events.withWatermark(time, delay) if delay else events
    return watched.groupBy(*keys, F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
