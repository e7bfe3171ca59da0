"""Event-time windows over call logs. An extension: the reference semantics know rounds and rolling days only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """Event time as TIMESTAMP, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    """Count and sum by type in windows; with ``late`` a watermark bounds the state of a stream."""
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if late else rows
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    rows = timed(events)
    rows = rows.withWatermark("ts", late) if late else rows
    w = F.session_window("ts", gap)
    return rows.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "user_id", "n")


def idempotent_sink(path: str):
    """A foreachBatch function: a batch goes to a folder of its own, so a batch that comes again replaces itself."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write
