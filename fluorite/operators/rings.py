"""A background that every pixel takes from a ring around it, by regression over time.

What the regressions need are sums over time of the products of near pixels. They are made where parts of the movie meet,
tile by tile with a halo and for blocks of time, summed, and brought to the tiles again: no task holds a tile's whole movie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored
from . import footprints as FP
from .tiling import with_halo

TILE, STEPS = 32, 4096


def ring(radius: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) over `radius` and up to radius + 1 away."""
    n = radius + 1
    return [(y, x) for x in range(-n, n + 1) for y in range(-n, n + 1) if radius * radius < y * y + x * x <= n * n]


def differences(radius: int) -> list[tuple[int, int]]:
    """Offsets between any two of a pixel and its ring, of each two opposite ones one, (0, 0) first."""
    own = [(0, 0), *ring(radius)]
    every = {(b[0] - a[0], b[1] - a[1]) for a in own for b in own}
    return sorted(o for o in every if (o[1], o[0]) >= (0, 0))


def products(frames: DataFrame, d1: int, d2: int, radius: int, tile: int = TILE, steps: int = STEPS) -> DataFrame:
    """(p, dy, dx, n, s, m): for each pixel and offset of differences(): the number of frames, the sum of the products of
    the pixel and its neighbour there, and the pixel's own sum. Frames that are null, of another size, or have a missing
    pixel are left out."""
    far = differences(radius)
    reach = 2 * (radius + 1)
    whole = frames.where((F.size("img") == d1 * d2) & F.forall("img", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = with_halo(whole.select("t", F.col("img").cast("array<double>").alias("img")), d1, d2, tile, reach).withColumn("block", F.floor(F.col("t") / steps))

    def sums(table):
        y0, x0, h, w, top, left, th, tw = (table.column(c)[0].as_py() for c in ("y0", "x0", "h", "w", "top", "left", "th", "tw"))
        x = table.column("img").combine_chunks().flatten().to_numpy().reshape(-1, tw, th)
        y, c = (g.ravel() for g in np.meshgrid(np.arange(h), np.arange(w), indexing="ij"))
        core = x[:, c + x0 - left, y + y0 - top]
        total, out = core.sum(axis=0), []
        for dy, dx in far:
            q, r = y + y0 + dy, c + x0 + dx
            inside = np.flatnonzero((q >= 0) & (q < d1) & (r >= 0) & (r < d2))
            s = np.einsum("ti,ti->i", core[:, inside], x[:, r[inside] - left, q[inside] - top])
            p = y[inside] + y0 + (c[inside] + x0) * d1
            out.append((p, np.full(len(p), dy), np.full(len(p), dx), np.full(len(p), len(x)), s, total[inside]))
        names = ("p", "dy", "dx", "n", "s", "m")
        return pa.table([pa.array(np.concatenate(v).astype(np.int64 if i < 4 else float)) for i, v in enumerate(zip(*out))], names=list(names))

    found = rows.groupBy("tile", "block").applyInArrow(sums, "p long, dy long, dx long, n long, s double, m double")
    return found.groupBy("p", "dy", "dx").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("m").alias("m"))


def weights(sums: DataFrame, d1: int, d2: int, radius: int, tile: int = TILE, ridge: float = 1e-5) -> DataFrame:
    """(p, q, w): how each pixel p is told from the pixels q of its ring: regressions of what they differ from their means,
    with `ridge` of the squared size of the ring's pixels added to each. Each tile gets the sums of its halo."""
    reach, around = radius + 1, ring(radius)
    y, x = F.pmod(F.col("p"), F.lit(d1)), F.floor(F.col("p") / d1)
    across = -(-d2 // tile)
    # The tiles whose halo holds a pixel.
    rows = F.sequence(F.floor(F.greatest(y - reach, F.lit(0)) / tile), F.floor(F.least(y + reach, F.lit(d1 - 1)) / tile))
    columns = F.sequence(F.floor(F.greatest(x - reach, F.lit(0)) / tile), F.floor(F.least(x + reach, F.lit(d2 - 1)) / tile))
    dealt = sums.withColumn("i", F.explode(rows)).withColumn("j", F.explode(columns)).withColumn("tile", (F.col("i") * across + F.col("j")).cast("int")).drop("i", "j")

    def solve(key, table):
        y0, x0 = key[0].as_py() // across * tile, key[0].as_py() % across * tile
        h, w = min(tile, d1 - y0), min(tile, d2 - x0)
        p, dy, dx, n, s, m = (table.column(c).to_numpy() for c in ("p", "dy", "dx", "n", "s", "m"))
        first = (dy == 0) & (dx == 0)
        mean = dict(zip(p[first].tolist(), (m[first] / n[first]).tolist()))
        cov = {(i, a, b): v / k for i, a, b, v, k in zip(p.tolist(), dy.tolist(), dx.tolist(), s.tolist(), n.tolist())}

        def between(a: tuple[int, int], b: tuple[int, int]) -> float:
            if (b[1] - a[1], b[0] - a[0]) < (0, 0):
                a, b = b, a
            i, j = a[0] + a[1] * d1, b[0] + b[1] * d1
            return cov[i, b[0] - a[0], b[1] - a[1]] - mean[i] * mean[j]

        ps, qs, ws = [], [], []
        for cx in range(x0, x0 + w):
            for cy in range(y0, y0 + h):
                near = [(cy + a, cx + b) for a, b in around if 0 <= cy + a < d1 and 0 <= cx + b < d2]
                if not near or (cy + cx * d1, 0, 0) not in cov:
                    continue
                gram = np.array([[between(a, b) for b in near] for a in near])
                seen = np.array([between((cy, cx), b) for b in near])
                gram[np.diag_indices(len(near))] += np.trace(gram) * ridge
                found = np.linalg.lstsq(gram, seen, rcond=None)[0] if np.trace(gram) > 0 else np.zeros(len(near))
                ps += [cy + cx * d1] * len(near)
                qs += [a + b * d1 for a, b in near]
                ws += found.tolist()
        return pa.table([pa.array(ps, pa.int64()), pa.array(qs, pa.int64()), pa.array(ws, pa.float64())], names=["p", "q", "w"])

    return dealt.groupBy("tile").applyInArrow(solve, "p long, q long, w double")


def means(sums: DataFrame) -> DataFrame:
    """(p, b0): each pixel's mean."""
    return sums.where("dy = 0 and dx = 0").select("p", (F.col("m") / F.col("n")).alias("b0"))


def model(frames: DataFrame, d1: int, d2: int, radius: int, a: DataFrame | None = None, traces: DataFrame | None = None, tile: int = TILE, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """(weights, means) of a movie's ring background, of what footprints and traces leave of it, if given."""
    rest = frames if a is None else FP.unexplained(a, frames, traces)
    sums = stored(products(rest, d1, d2, radius, tile, steps))
    return stored(weights(sums, d1, d2, radius, tile)), stored(means(sums))


def background(frames: DataFrame, w: DataFrame, b0: DataFrame) -> DataFrame:
    """(t, p, v): the ring background of each frame: a pixel's mean, and its weights times how its ring differs from its own
    means. frames may have been cleared of components, by unexplained()."""
    level = b0.join(w.groupBy("p", "q").agg(F.sum("w").alias("w")).join(b0.select(F.col("p").alias("q"), F.col("b0").alias("c")), "q").groupBy("p").agg(F.sum(F.col("w") * F.col("c")).alias("less")), "p", "left")
    level = level.select("p", (F.col("b0") - F.coalesce("less", F.lit(0.0))).alias("level"))
    seen = FP.seen(w.select(F.col("p").alias("k"), F.col("q").alias("p"), "w"), frames)
    return seen.join(level, F.col("k") == F.col("p")).select("t", "p", (F.col("v") + F.col("level")).alias("v"))
