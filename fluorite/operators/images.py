"""Operators on frames: stencils, summary and correlation images.

A stencil reads a frame's own array, a batch of frames at once, without any shuffle; an image over time is one grouped
aggregate, combined on the map side: what is shuffled is pixels by neighbours, not the movie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .motion import images as image_batch
from .motion import map_frames

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0))


def _inside(p: Column, dy: int, dx: int, d1: int, d2: int) -> Column:
    y, x = p % d1 + dy, F.floor(p / d1) + dx
    return (y >= 0) & (y < d1) & (x >= 0) & (x < d2)


def neighbours(frames: DataFrame, d1: int, d2: int, offsets, keep: tuple[str, ...] = ("session", "t")) -> DataFrame:
    """(keep..., p, o, v, v2): each pixel's value beside that of its neighbour at offsets[o], inside the frame only."""
    k = len(offsets)
    shift = F.array(*[F.lit(dy + dx * d1) for dy, dx in offsets])

    def inside(e: Column) -> Column:
        p, ok = F.floor(e / k), F.lit(False)
        for i, (dy, dx) in enumerate(offsets):
            ok = F.when(e % k == i, _inside(p, dy, dx, d1, d2)).otherwise(ok)
        return ok

    cells = F.filter(F.sequence(F.lit(0), F.lit(d1 * d2 * k - 1)), inside)
    pair = F.transform(cells, lambda e: F.struct(
        F.floor(e / k).cast("int").alias("p"), (e % k).alias("o"), F.get("img", F.floor(e / k).cast("int")).alias("v"),
        F.get("img", F.floor(e / k).cast("int") + F.get(shift, e % k)).alias("v2"),
    ))
    return frames.select(*keep, F.explode(pair).alias("c")).select(*keep, "c.p", "c.o", "c.v", "c.v2")


def _borders(x: np.ndarray, reach: int, mode: str = "edge") -> np.ndarray:
    return np.pad(x, ((0, 0), (reach, reach), (reach, reach)), mode=mode)


def filter_frames(frames: DataFrame, d1: int, d2: int, kernel: dict[tuple[int, int], float], mode: str = "edge") -> DataFrame:
    """Frames filtered by a kernel {(dy, dx): weight}; borders are repeated outwards, or as another mode of np.pad has it.
    A batch of frames at once, no shuffle."""
    reach = max(max(abs(a), abs(b)) for a, b in kernel)

    def run(x: np.ndarray) -> np.ndarray:
        wide, out = _borders(x, reach, mode), np.zeros(x.shape)
        for (dy, dx), w in sorted(kernel.items()):
            out += w * wide[:, reach + dy : reach + dy + d1, reach + dx : reach + dx + d2]
        return out

    return map_frames(frames, d1, d2, run)


def rank_frames(frames: DataFrame, d1: int, d2: int, reach: int, what: str, mode: str = "edge") -> DataFrame:
    """Frames filtered by the median, maximum or minimum of squares of 2 * reach + 1 pixels, borders as above."""
    def run(x: np.ndarray) -> np.ndarray:
        wide = _borders(x, reach, mode)
        around = np.stack([wide[:, a : a + d1, b : b + d2] for a in range(2 * reach + 1) for b in range(2 * reach + 1)])
        return {"median": np.median, "max": np.max, "min": np.min}[what](around, axis=0)

    return map_frames(frames, d1, d2, run)


def bilateral(frames: DataFrame, d1: int, d2: int, reach: int, space: float, values: float) -> DataFrame:
    """Frames smoothed by neighbours, weighted by how near they are in space and in value: edges stay."""
    def run(x: np.ndarray) -> np.ndarray:
        wide, total, weight = _borders(x, reach), np.zeros(x.shape), np.zeros(x.shape)
        for a in range(-reach, reach + 1):
            for b in range(-reach, reach + 1):
                other = wide[:, reach + a : reach + a + d1, reach + b : reach + b + d2]
                w = np.exp(-(a * a + b * b) / (2 * space * space) - (other - x) ** 2 / (2 * values * values))
                total, weight = total + w * other, weight + w
        return total / weight

    return map_frames(frames, d1, d2, run)


def box(reach: int) -> dict[tuple[int, int], float]:
    side = 2 * reach + 1
    return {(a, b): 1.0 / side**2 for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)}


def gaussian(sigma: float, reach: int) -> dict[tuple[int, int], float]:
    import math

    raw = {(a, b): math.exp(-(a * a + b * b) / (2 * sigma * sigma)) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def high_pass(sigma: float, reach: int) -> dict[tuple[int, int], float]:
    """A Gaussian with its mean taken off: flat areas become zero."""
    g = gaussian(sigma, reach)
    mean = sum(g.values()) / len(g)
    return {k: v - mean for k, v in g.items()}


def summary(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("p").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("max"), F.min("v").alias("min"))


def bin_median(pixels: DataFrame, bins: int) -> DataFrame:
    """The median over bins of each bin's mean; bins are interleaved: frame t falls in bin t mod bins."""
    return pixels.groupBy("p", F.expr(f"t % {bins}").alias("b")).agg(F.avg("v").alias("v")).groupBy("p").agg(F.percentile("v", 0.5).alias("v"))


def local_correlations(frames: DataFrame, d1: int, d2: int, offsets=EIGHT, mean: str = "arithmetic", by: tuple[str, ...] = ()) -> DataFrame:
    """Each pixel's mean correlation over time with its neighbours; a pixel without variance counts as uncorrelated."""
    pair = neighbours(frames, d1, d2, offsets, ("session", "t")).groupBy(*by, "p", "o").agg(F.corr("v", "v2").alias("r"))
    r = F.coalesce(F.when(F.isnan("r"), None).otherwise(F.col("r")), F.lit(0.0))
    if mean == "geometric":
        return pair.groupBy(*by, "p").agg(F.exp(F.avg(F.log(F.greatest(r, F.lit(1e-6))))).alias("r"))
    return pair.groupBy(*by, "p").agg(F.avg(r).alias("r"))


def max_correlations(frames: DataFrame, d1: int, d2: int, bin_size: int) -> DataFrame:
    """The largest correlation image of bins of consecutive frames."""
    binned = frames.withColumn("session", F.floor(F.col("t") / bin_size))
    return local_correlations(binned, d1, d2, by=("session",)).groupBy("p").agg(F.max("r").alias("r"))


def correlation_movie(frames: DataFrame, d1: int, d2: int, window: int | None) -> DataFrame:
    """A correlation image for each frame, over the last `window` frames, or over all so far (None).

    Running moments of neighbouring pixels: a window over one pair of pixels, so partitions are pairs, not the movie.
    """
    over = Window.partitionBy("p", "o").orderBy("t").rowsBetween(Window.unboundedPreceding if window is None else -(window - 1), 0)
    r = neighbours(frames, d1, d2, FOUR, ("t",)).withColumn("r", F.corr("v", "v2").over(over)).withColumn("n", F.count("v").over(over))
    return r.where(F.col("n") >= (2 if window is None else window)).groupBy("t", "p").agg(F.avg("r").alias("r"))


def peak_to_noise(pixels: DataFrame) -> DataFrame:
    """The height of each pixel's largest value over its median, in units of the spread of its differences."""
    by = Window.partitionBy("p").orderBy("t")
    step = pixels.withColumn("d", F.col("v") - F.lag("v").over(by))
    return step.groupBy("p").agg(((F.max("v") - F.percentile("v", 0.5)) / (F.stddev_pop("d") / F.sqrt(F.lit(2.0)))).alias("pnr"))


def downscale(pixels: DataFrame, d1: int, space: int, time: int) -> DataFrame:
    """Block means over space and time; what is left at the ends makes smaller blocks."""
    y, x = F.expr(f"p % {d1} div {space}"), F.expr(f"p div {d1} div {space}")
    return pixels.groupBy(F.expr(f"t div {time}").alias("t"), y.alias("y"), x.alias("x")).agg(F.avg("v").alias("v"))


def crispness(frames: DataFrame, d1: int, d2: int) -> DataFrame:
    """The Euclidean norm of the gradient of the mean image's forward differences, a measure of how sharp it is."""
    mean = frames.select("t", F.posexplode("img").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("v"))
    m = mean.select("v", (F.col("p") % d1).alias("y"), F.floor(F.col("p") / d1).alias("x"))
    down = F.lead("v").over(Window.partitionBy("x").orderBy("y")) - F.col("v")
    right = F.lead("v").over(Window.partitionBy("y").orderBy("x")) - F.col("v")
    return m.select(F.coalesce(down, F.lit(0.0)).alias("a"), F.coalesce(right, F.lit(0.0)).alias("b")).agg(F.sqrt(F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b"))).alias("crispness"))


def rigid_shifts(frames: DataFrame, template: DataFrame, d1: int, d2: int, reach: int) -> DataFrame:
    """Each frame's best whole shift up to `reach` (the first in order of dy, dx among equals), by its correlation with a
    template (p, v), one image, over the pixels that both have."""
    ref = np.zeros(d1 * d2)
    for r in template.collect():  # one image
        ref[r["p"]] = r["v"]
    ref = ref.reshape(d2, d1).T
    offsets = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]

    def run(batches):
        for batch in batches:
            x = image_batch(batch, d1, d2)
            scores = []
            for dy, dx in offsets:
                y0, y1, x0, x1 = max(0, -dy), min(d1, d1 - dy), max(0, -dx), min(d2, d2 - dx)
                a, b = x[:, y0 + dy : y1 + dy, x0 + dx : x1 + dx].reshape(len(x), -1), ref[y0:y1, x0:x1].ravel()
                a, b = a - a.mean(axis=1, keepdims=True), b - b.mean()
                size = np.sqrt((a * a).sum(axis=1) * (b @ b))
                scores.append(np.where(size > 0, a @ b / np.where(size > 0, size, 1), np.nan))
            r = np.round(np.stack(scores, axis=1), 9)
            some = ~np.isnan(r).all(axis=1)
            best = np.where(np.isnan(r), -2, r).argmax(axis=1)
            at = np.flatnonzero(some)
            pick = np.array(offsets, dtype=np.int32)[best[at]]
            score = np.stack(scores, axis=1)[at, best[at]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(pick[:, 0]), pa.array(pick[:, 1]), pa.array(score)], names=["t", "dy", "dx", "r"])

    return frames.select("t", "img").mapInArrow(run, f"t {dict(frames.dtypes)['t']}, dy int, dx int, r double")


def apply_shift(frames: DataFrame, d1: int, d2: int, dy: int, dx: int, fill: float = 0.0) -> DataFrame:
    """Frames moved by a whole shift; what comes in from outside has the value `fill`."""
    def run(x: np.ndarray) -> np.ndarray:
        out = np.full(x.shape, fill)
        out[:, max(0, dy) : d1 + min(0, dy), max(0, dx) : d2 + min(0, dx)] = x[:, max(0, -dy) : d1 - max(0, dy), max(0, -dx) : d2 - max(0, dx)]
        return out

    return map_frames(frames, d1, d2, run)


def ring(d1: int, d2: int, radius: int) -> list[tuple[int, int]]:
    """Offsets whose distance is at least `radius` and under radius + 1."""
    reach = radius + 1
    return [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if radius**2 <= a * a + b * b < (radius + 1) ** 2]


def ring_background(frames: DataFrame, d1: int, d2: int, radius: int) -> DataFrame:
    """(t, p, v): the mean over each pixel's ring, as far as it lies in the field. A stencil with a count, no shuffle."""
    around, reach = ring(d1, d2, radius), radius + 1

    def run(x: np.ndarray) -> np.ndarray:
        wide = np.pad(x, ((0, 0), (reach, reach), (reach, reach)))
        here = np.pad(np.ones((d1, d2)), reach)
        cut = lambda z, a, b: z[..., reach + a : reach + a + d1, reach + b : reach + b + d2]
        n = sum(cut(here, a, b) for a, b in around)
        return sum(cut(wide, a, b) for a, b in around) / np.where(n > 0, n, np.nan)

    return map_frames(frames, d1, d2, run).select("t", F.posexplode("img").alias("p", "v")).where(~F.isnan("v"))


def affinity(frames: DataFrame, d1: int, d2: int, top: int) -> DataFrame:
    """The `top` most alike neighbours of each pixel by exp(-mean squared difference): a sparse graph."""
    pair = neighbours(frames, d1, d2, EIGHT, ("t",)).groupBy("p", "o").agg(F.exp(-F.avg((F.col("v") - F.col("v2")) * (F.col("v") - F.col("v2")))).alias("w"))
    best = Window.partitionBy("p").orderBy(F.round("w", 9).desc(), "o")
    return pair.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top).drop("n")
