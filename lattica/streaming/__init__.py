"""Structured Streaming: windows over event time with late data, and a memory kept per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.config import STATE


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1, name: str = "*.parquet") -> DataFrame:
    """Events with ``ts`` as an instant, which watermarks need; ``name`` says which files of the folder are taken."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and mean by window and type; rows later than the watermark are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    summed = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return summed.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def memory_by_key(events: DataFrame, ceiling: float, decay: float = STATE.decay, floor: float = STATE.memory_floor) -> DataFrame:
    """The leaky memory of each event type over micro-batches: rows of a batch are taken by time."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        memory = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for value in rows["value"]:
            memory = max(decay * memory + max(value - ceiling, 0.0), floor)
            out.append(memory)
        state.update((memory,))
        yield pd.DataFrame({"event_type": key[0], "event_id": rows["event_id"].to_numpy(), "memory": out})

    return events.groupBy("event_type").applyInPandasWithState(update, "event_type string, event_id long, memory double", "memory double", "append", "NoTimeout")
