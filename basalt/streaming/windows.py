"""Windowed aggregates over a stream of events, late data bounded by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import folder


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum of value by window and event type; works on streams and on tables."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def tumbling(spark: SparkSession, path: str, schema) -> DataFrame:
    """Run the stream of the files below path to its end; gives the table of the windows.

    Each batch writes the windows that it changed under its own number (a repeated batch overwrites it), and the last
    state of a window counts.  In this mode the watermark drops old windows' state and late events."""
    root = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    place, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(place)
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/windows/batch={n}")
    windowed(source).writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    changed = spark.read.parquet(f"{root}/windows")
    last = changed.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("w"))
    return last.select("window_start", "event_type", "w.n", "w.total")
