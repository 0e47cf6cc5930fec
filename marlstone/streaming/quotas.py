"""Usage windows over an event stream, the twins of the batch queries.

Late events count up to the watermark; a window's row is final and appended
once the watermark has passed its end, and its state is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def usage(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """user_id, win, used: events by user in tumbling windows."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("user_id", F.window("at", window).alias("w")).agg(F.count("*").alias("used")).select("user_id", F.col("w.start").alias("win"), "used")


def deduplicated(events: DataFrame, late: str = "30 days") -> DataFrame:
    """Each event once; ids are forgotten when the watermark has passed them."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]).drop("at")


def run_to_table(frame: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, exactly once per checkpoint, and stop."""
    return frame.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_complete(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Windows that are still open too: every batch rewrites the table."""
    return frame.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
