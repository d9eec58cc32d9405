"""Movies, traces and footprints as DataFrames, and the driver's tables in those roles.

frames:      session, t, img ARRAY<DOUBLE>    a frame's pixels in column-major order: p = y + x * d1
pixels:      session, t, p, v
traces:      k, t, v
footprints:  k, p, w                          one row for each pixel that a component covers
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The driver's movie: frames of 8 by 8 pixels; its footprints lie on rows of 50 pixels; its traces have a step an hour.
D1, D2, WIDTH, STEPS = 8, 8, 50, 720


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir; what is there goes when the JVM ends.

    Where none is named, a local master gets a folder of its own; a cluster's executors wouldn't see one, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        base = "file://" + tempfile.mkdtemp()
    path = f"{base}/{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again, a cut of the lineage."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("session"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("img")
    )


def pixels(frames: DataFrame) -> DataFrame:
    return frames.select("session", "t", F.posexplode("img").alias("p", "v"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3_600_000_000).cast("int")
    return e.select(F.col("event_type").alias("k"), "user_id", hour.alias("t"), "value", "props", F.col("ts").cast("timestamp").alias("ts"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of values in every step of each kind of event, zero where there is none: kinds by steps, a full grid."""
    e = events(spark, sf_dir).groupBy("k", "t").agg(F.round(F.sum("value"), 6).alias("v"))
    grid = e.select("k").distinct().select("k", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("t"))
    return grid.join(e, ["k", "t"], "left").select("k", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")).agg(F.sum("l_quantity").alias("w"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels that each component has in each session: set_id, k, p."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("set_id"), F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")).distinct()
