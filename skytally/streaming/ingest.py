"""Results that arrive as files, processed in batches as they come; and counts per window of event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    """A stream of the JSON lines in a folder, so many files at a time (one: each file as it comes)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived, as Parquet, exactly once, and stops."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def window_counts(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and mean value per window of ts and event_type; events later than the watermark are left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def status(query: StreamingQuery) -> dict:
    """A stream's state for whoever polls it: its id, whether it runs, batches and rows done, and what stopped it."""
    done = query.recentProgress
    return {"id": str(query.id), "active": query.isActive, "batches": len(done), "rows": sum(p["numInputRows"] for p in done), "message": query.status["message"], "error": str(query.exception() or "")}


def infer(rows: DataFrame, predict: Callable, schema: str) -> DataFrame:
    """predict over a table or stream in Arrow batches: it gets an iterator of pandas frames, in which it may keep a model, and yields frames of schema. Spark bounds what waits between the steps."""
    return rows.mapInPandas(predict, schema)
