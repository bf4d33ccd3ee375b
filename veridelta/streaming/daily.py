"""Structured Streaming over events: windowed counts with a watermark, dedup, and a first-wins state per key.

``replay`` runs a stream over files to its end with availableNow and gives the sink's table, so that a finished stream can be
held against the batch query. Checkpoints and sink lie in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.session import path_exists, shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int = 8) -> DataFrame:
    """The events table as a stream; ts becomes a timestamp, since watermarks don't take timestamp_ntz."""
    import os

    path = f"{folder}/{name}"
    reader = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(path) if not os.path.isfile(path) else reader.option("pathGlobFilter", name).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events, users and sum of values by day and type; days are emitted when the watermark has passed them."""
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def dedup(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user, closed by ``gap`` without an event."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def replay(spark: SparkSession, stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run to the end of what is there; the sink's rows. ``complete`` keeps the last batch only."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)
        if each:
            each(df, batch)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if path_exists(spark, out) else spark.createDataFrame([], stream.schema)
