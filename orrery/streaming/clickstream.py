"""The same clickstream operators over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, time: str = "ts") -> DataFrame:
    """A watermark needs a timestamp with a zone."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "12 hours") -> DataFrame:
    return timed(events, time).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def guarded(events: DataFrame, time: str = "ts", future: str = "5 minutes") -> DataFrame:
    """Drops events that lie ahead of the clock; the watermark drops those too far back."""
    return timed(events, time).where(F.col(time) <= F.current_timestamp() + F.expr(f"interval {future}"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, time: str = "ts", by: tuple[str, ...] = ("event_type",), delay: str = "12 hours") -> DataFrame:
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return timed(events, time).withWatermark(time, delay).groupBy(window, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", user: str = "user_id", delay: str = "12 hours") -> DataFrame:
    w = F.session_window(time, gap)
    return timed(events, time).withWatermark(time, delay).groupBy(w, user).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), user, "n")


def drain(queue: DataFrame, handle, checkpoint: str, every: str = "5 seconds", available_now: bool = False):
    """Hands each micro-batch to handle(batch, id)."""
    writer = queue.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()
