"""Streaming forms: moments, tumbling means, sessions and duplicates over a stream of events or frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream with event time."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not path.endswith(".parquet") else f"{sf_dir}/events.parque[t]")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its result as a table.

    What a stream appends is as large as its input and goes to files in the shared folder; only aggregates, which other
    modes rewrite, are held by the driver.
    """
    spark = stream.sparkSession
    name, base = "s" + uuid.uuid4().hex, shared_path(spark)
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode != "append":
        out.format("memory").queryName(name).start().awaitTermination()
        return spark.table(name)
    out.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def running_moments(events: DataFrame) -> DataFrame:
    """Count, sum and sum of squares of each kind's values so far."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"), F.round(F.sum(F.col("value") * F.col("value")), 4).alias("ss"))


def tumbling_means(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(
        F.unix_timestamp("w.start").alias("start"), "event_type", "n", "mean"
    )


def activity_sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Bouts of activity of each user: events less than `gap` apart."""
    return events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def without_duplicates(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type", "value")
