"""An extra beyond the batch operators: counts of events in time windows, on streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): rows later than `late` behind the newest are dropped on a stream; a table keeps all."""
    kind = dict(events.dtypes)["ts"]
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks want a time with zone
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("w")["start"].cast(kind).alias("window_start"), "event_type", "n", "total")


def on_each_batch(stream: DataFrame, heard, checkpoint: str | None = None):
    """Starts a query that hands every micro-batch (DataFrame, number) to a callback."""
    writer = stream.writeStream.foreachBatch(heard)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
