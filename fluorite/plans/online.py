"""Registered queries of streams with state: incremental deconvolution, online demixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.online import Settings
from ..sources import tables as T
from ..streaming import stateful as ST
from .catalogue import _query, D1, D2

#: Decay of the driver's traces for a step, and the steps before which the stream is stopped and goes on.
DECAY, STOPS = 0.9, [100, 101, 400]


@_query()
def stream_deconvolve(spark: SparkSession, d: str) -> DataFrame:
    """Traces that arrive in pieces, deconvolved as they come: what all pieces together say of each step."""
    out = ST.in_pieces(T.traces(spark, d), STOPS, lambda s: ST.pools(s, DECAY))
    return ST.current(out, DECAY).select("k", "t", F.round("c", 6).alias("c"), F.round("s", 6).alias("s"))


@_query()
def online_demix(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that arrive as a stream, demixed frame by frame: values and footprints as they are found."""
    frames = T.frames(spark, d)
    settings = Settings(d1=D1, d2=D2, radius=2, start=12, buffer=24, update_every=8, space_corr=0.5, least_snr=2.0)
    base = T.shared_path(spark)
    frames.write.parquet(f"{base}/in")
    out = ST.demixed(spark.readStream.schema(frames.schema).parquet(f"{base}/in"), settings)
    ST.written(out, base)
    return spark.read.schema(out.schema).parquet(f"{base}/out")
