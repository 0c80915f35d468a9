"""Ingestion of points as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def slotted(points: DataFrame, step: int, lateness: str = "10 minutes") -> DataFrame:
    """name, ts and v: sums over slots of a stream (name, time, value). Points later than
    ``lateness`` are left out, and a slot is final once the watermark has passed it."""
    window = F.window("time", f"{step} seconds")
    return points.withWatermark("time", lateness).groupBy("name", window.alias("w")).agg(F.sum("value").alias("v")).select("name", F.unix_timestamp("w.start").alias("ts"), "v")


def store(points: DataFrame, step: int, path: str, checkpoint: str, lateness: str = "10 minutes") -> StreamingQuery:
    """Appends final slots to a Parquet point table, once each."""
    return slotted(points, step, lateness).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
