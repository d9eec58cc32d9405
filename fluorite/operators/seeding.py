"""One-photon components by seeds, tile by tile with halos, without doubles over tiles' borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.seeding import Seeding, seeded
from ..sources.tables import stored
from .tiling import gathered, with_halo


def slower(frames: DataFrame, steps: int) -> DataFrame:
    """Frames averaged over blocks of `steps`: (t, img) with t the block."""
    pixels = frames.select(F.floor(F.col("t") / steps).alias("t"), F.posexplode("img").alias("p", "v")).groupBy("t", "p").agg(F.avg("v").alias("v"))
    return pixels.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("img"))


def components(frames: DataFrame, d1: int, d2: int, settings: Seeding, tile: int = 32, alike: float = 0.6) -> DataFrame:
    """(k, score, p, w): footprints of unit length of what a movie (t, img) holds on its background; k is the seed's pixel.

    A task holds one tile with its halo for all steps, twice, so the tile's side bounds it; slower() makes long movies shorter. A
    tile keeps what has its seed inside; of components of different tiles whose footprints are alike (cosine over `alike`)
    the one of the better seed stays. Frames that are null, of another size, or have a missing pixel are left out.
    """
    whole = frames.where((F.size("img") == d1 * d2) & F.forall("img", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = with_halo(whole.select("t", F.col("img").cast("array<double>").alias("img")), d1, d2, tile, settings.halo)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tile, y0, x0, h, w, top, left, th, tw), _, movie = gathered(batches, "tile", "y0", "x0", "h", "w", "top", "left", "th", "tw")
        movie = movie.reshape(-1, tw, th).transpose(0, 2, 1)
        k, score, p, weight = [], [], [], []
        for (y, x), value, image, _ in seeded(movie, settings, (slice(y0 - top, y0 - top + h), slice(x0 - left, x0 - left + w)), own=True):
            ys, xs = np.nonzero(image)
            k += [y + top + (x + left) * d1] * len(ys)
            score += [value] * len(ys)
            p += (ys + top + (xs + left) * d1).tolist()
            weight += (image[ys, xs] / np.linalg.norm(image)).tolist()
        n = [tile] * len(k)
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(k, pa.int64()), pa.array(score, pa.float64()), pa.array(p, pa.int64()), pa.array(weight, pa.float64())], names=["tile", "k", "score", "p", "w"])

    found = stored(rows.groupBy("tile").applyInArrow(find, "tile int, k long, score double, p long, w double"))
    other = found.select(F.col("tile").alias("tile2"), F.col("k").alias("k2"), F.col("score").alias("score2"), "p", F.col("w").alias("w2"))
    meet = found.join(other, "p").where("tile <> tile2 and (score2 > score or score2 = score and k2 < k)")
    worse = meet.groupBy("k", "k2").agg(F.sum(F.col("w") * F.col("w2")).alias("c")).where(F.col("c") > alike).select("k").distinct()
    return found.join(worse, "k", "left_anti").select("k", "score", "p", "w")
