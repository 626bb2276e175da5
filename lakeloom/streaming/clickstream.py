"""Clickstream events: parsing, de-duplication under a watermark, sessions. The same code serves batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

EVENT = StructType([
    StructField("event_id", LongType()), StructField("event_time", TimestampType()), StructField("customer_id", LongType()),
    StructField("session_id", StringType()), StructField("event_type", StringType()), StructField("product_id", LongType()),
    StructField("channel", StringType()),
])


def parse(raw: DataFrame, column: str = "json") -> DataFrame:
    """JSON text to events; what can't be read has nulls."""
    return raw.select(F.from_json(column, EVENT).alias("e")).select("e.*")


def deduplicated(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first event of each id. In a stream, ids are remembered for the delay and later events are dropped."""
    if events.isStreaming:
        return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["event_id"])
    return events.groupBy("event_id").agg(F.min(F.struct("event_time", *[c for c in events.columns if c not in ("event_id", "event_time")])).alias("e")).select("event_id", "e.*")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events of a customer with no gap that long between them."""
    if events.isStreaming:
        events = events.withWatermark("event_time", delay)
    made = events.groupBy("customer_id", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("events"))
    return made.select("customer_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Starts the stream into Parquet files; the checkpoint lets a restart go on where it was."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
