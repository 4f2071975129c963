"""Streams, an addition of this engine: windowed counts with late data, and micro-batch upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.store import Table


def windowed(events: DataFrame, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums by window and key; rows later than ``late`` are dropped by the watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def upsert_stream(stream: DataFrame, target: Table, checkpoint: str):
    """Starts a query that upserts each micro-batch; a replayed batch gives the same table."""
    return stream.writeStream.foreachBatch(lambda batch, _: target.upsert(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
