"""Dense motion from each frame to the next."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flow import motion


def flow(frames: DataFrame, d1: int, d2: int, levels: int = 3, reach: int = 4, sigma: float = 1.5, window: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """(keys, t, dy array, dx array): the motion of each pixel from frame t to frame t + 1, of the same keys, column-major.

    One join brings two frames together, wherever they lie. A frame without a next one has no row, nor have frames that are
    null, of another size, or have a missing pixel.
    """
    kinds = dict(frames.dtypes)
    whole = frames.where((F.size("img") == d1 * d2) & F.forall("img", lambda v: v.isNotNull() & ~F.isnan(v))).select(*by, "t", F.col("img").cast("array<double>").alias("img"))
    after = whole.select(*by, (F.col("t") - 1).alias("t"), F.col("img").alias("next"))
    both = whole.join(after, [*by, "t"])

    def run(batches):
        for batch in batches:
            n = len(by)
            one, two = (batch.column(i).flatten().to_numpy().reshape(-1, d2, d1).transpose(0, 2, 1) for i in (n + 1, n + 2))
            found = [motion(a, b, levels, reach, sigma, window) for a, b in zip(one, two)]
            parts = [pa.array([f[..., i].ravel(order="F") for f in found], pa.list_(pa.float64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], batch.column(n).cast(pa.int64()), *parts], names=[*by, "t", "dy", "dx"])

    keys = "".join(f"{c} {kinds[c]}, " for c in by)
    return both.select(*by, "t", "img", "next").mapInArrow(run, f"{keys}t long, dy array<double>, dx array<double>")


def polar(moved: DataFrame) -> DataFrame:
    """(t, p, size, angle) of each pixel's motion."""
    rows = moved.select("t", F.posexplode(F.arrays_zip("dy", "dx")).alias("p", "d"))
    return rows.select("t", "p", F.hypot("d.dy", "d.dx").alias("size"), F.atan2("d.dy", "d.dx").alias("angle"))


def restlessness(moved: DataFrame) -> DataFrame:
    """(t, size): how much a frame moves, the root of the mean squared motion of its pixels."""
    return polar(moved).groupBy("t").agg(F.sqrt(F.avg(F.col("size") * F.col("size"))).alias("size"))
