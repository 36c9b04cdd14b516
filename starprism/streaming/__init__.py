"""Feeds: micro-batches that append to a store, and windowed aggregates with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_batches(stream: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``append`` for what has arrived, then stops. A batch whose number was taken already must change nothing."""
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_parquet(path: str) -> Callable[[DataFrame, int], None]:
    """Appends batches as folders named by their number, so that a repeated batch replaces itself."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return append


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """With a watermark if there is a bound; that needs timestamps with a time zone (the session's)."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events


def windowed(events: DataFrame, time: str, keys: list[str], length: str, slide: str | None = None, late: str | None = None, value: str | None = None) -> DataFrame:
    """Counts, and sums of ``value``, by window and keys; with ``late``, rows later than that are dropped by a watermark."""
    rows = _watermarked(events, time, late)
    more = [F.sum(value).alias("total")] if value else []
    return rows.groupBy(F.window(time, length, slide or length), *keys).agg(F.count(F.lit(1)).alias("n"), *more).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", *(["total"] if value else []))


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a key: rows with less than ``gap`` between them."""
    rows = _watermarked(events, time, late)
    return rows.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")
