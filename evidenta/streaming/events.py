"""Figures over event streams: tumbling totals with a watermark, sessions, and an incomplete last window.

The same functions run on a static table (a batch is a finished stream), which is how they are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.functions.scalars import money

LATE, WINDOW, GAP = "1 day", "1 day", "30 minutes"


def event_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files; late rows beyond the watermark are dropped by the aggregations below."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """Event time as an instant (watermarks need one), with a watermark on streams."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late) if events.isStreaming else timed


def window_totals(events: DataFrame, time: str = "ts", by: str = "event_type", value: str = "value", late: str = LATE, window: str = WINDOW) -> DataFrame:
    """(window start, group, n, total) of tumbling windows."""
    marked = _marked(events, time, late)
    return marked.groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(money(F.col(value))).cast("double").alias("total")).select(
        F.col("w.start").alias("window_start"), by, "n", "total"
    )


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = GAP, late: str = LATE) -> DataFrame:
    """(user, start, end, n) of sessions that end after ``gap`` without an event."""
    marked = _marked(events, time, late)
    return marked.groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream to the end of what is there, exactly once per checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(sink)
    query.awaitTermination()
