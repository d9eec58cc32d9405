"""Registered queries of registration in three dimensions, by interpolated fields, and of dense motion, with SQL where it can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flow as OF
from ..operators import volumes as V
from ..sources import tables as T
from .catalogue import _FRAMES, _query, D1, D2

#: The driver's frames as volumes.
DIMS = (4, 4, 4)


@_query(f"""WITH {_FRAMES}, m AS (SELECT p, quantile_cont(v, 0.5) AS m FROM (SELECT p, t % 10 AS b, avg(v) AS v FROM px GROUP BY ALL) GROUP BY p),
s AS (SELECT dy, dx, dz FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dz)),
w AS (SELECT dy, dx, dz, q.p, m.m - (SELECT avg(m) FROM m) AS m FROM s, (SELECT DISTINCT p FROM px) q JOIN m ON m.p = (q.p % 4 + dy + 4) % 4 + 4 * ((q.p // 4 % 4 + dx + 4) % 4) + 16 * ((q.p // 16 + dz + 4) % 4)),
r AS (SELECT t, dy, dx, dz, sum(v * m) AS r FROM px JOIN w USING (p) GROUP BY ALL)
SELECT t, dy::DOUBLE AS dy, dx::DOUBLE AS dx, dz::DOUBLE AS dz FROM r QUALIFY row_number() OVER (PARTITION BY t ORDER BY r DESC) = 1""")
def volume_shift_best(spark: SparkSession, d: str) -> DataFrame:
    """The whole shift of each volume, at most one along each axis."""
    frames = T.frames(spark, d)
    return V.shifts(frames, V.template_of(frames, DIMS), 1, upsample=1)


@_query()
def volume_shifts(spark: SparkSession, d: str) -> DataFrame:
    frames = T.frames(spark, d)
    return V.shifts(frames, V.template_of(frames, DIMS), 1.5, upsample=10)


@_query()
def volume_correct(spark: SparkSession, d: str) -> DataFrame:
    frames = T.frames(spark, d)
    return V.correct(frames, V.template_of(frames, DIMS), 1.5).select("t", F.posexplode("img").alias("p", "v"))


@_query()
def motion_warp_movie(spark: SparkSession, d: str) -> DataFrame:
    """Images warped by interpolated shifts of overlapping tiles, onto a template that was refined by warped frames."""
    out, _ = V.aligned(T.frames(spark, d), (D1, D2), 2.0, (4, 4), (2, 2), 1.0)
    return out.select("t", F.posexplode("img").alias("p", "v"))


@_query()
def volume_tile_shifts(spark: SparkSession, d: str) -> DataFrame:
    frames = T.frames(spark, d)
    return V.tile_shifts(frames, V.template_of(frames, DIMS), 1.0, (3, 3, 3), (1, 1, 1), 0.5)


@_query()
def optical_flow(spark: SparkSession, d: str) -> DataFrame:
    """The motion of each pixel from each frame to the next."""
    return OF.polar(OF.flow(T.frames(spark, d), D1, D2, levels=1, reach=2, sigma=1.0, window=2))
