"""Frames cut into tiles."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiled(frames: DataFrame, d1: int, d2: int, size: int) -> DataFrame:
    """(session, tile, y0, x0, t, img): frames cut into tiles of size by size pixels, the last ones smaller; a tile is a
    field of its own, so that no key holds a whole large frame. Expressions only."""
    rows = []
    for i, (y0, x0) in enumerate((y, x) for y in range(0, d1, size) for x in range(0, d2, size)):
        h, w = min(size, d1 - y0), min(size, d2 - x0)
        columns = [F.slice("img", y0 + x * d1 + 1, h) for x in range(x0, x0 + w)]
        rows.append(F.struct(F.lit(i).alias("tile"), F.lit(y0).alias("y0"), F.lit(x0).alias("x0"), F.lit(h).alias("d1"), F.lit(w).alias("d2"), F.concat(*columns).alias("img")))
    return frames.select("session", "t", F.explode(F.array(*rows)).alias("r")).select("session", "r.tile", "r.y0", "r.x0", "r.d1", "r.d2", "t", "r.img")


def with_halo(frames: DataFrame, d1: int, d2: int, size: int, halo: int) -> DataFrame:
    """(tile, t, y0, x0, h, w, top, left, th, tw, img): frames cut into tiles (y0, x0, h, w) with up to `halo` pixels around
    them: img is the part (top, left, th, tw). Expressions only."""
    rows = []
    for i, (y0, x0) in enumerate((y, x) for y in range(0, d1, size) for x in range(0, d2, size)):
        h, w, top, left = min(size, d1 - y0), min(size, d2 - x0), max(0, y0 - halo), max(0, x0 - halo)
        th, tw = min(d1, y0 + h + halo) - top, min(d2, x0 + w + halo) - left
        columns = [F.slice("img", top + x * d1 + 1, th) for x in range(left, left + tw)]
        numbers = {"tile": i, "y0": y0, "x0": x0, "h": h, "w": w, "top": top, "left": left, "th": th, "tw": tw}
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in numbers.items()], F.concat(*columns).alias("img")))
    return frames.select("t", F.explode(F.array(*rows)).alias("r")).select("r.tile", "t", *[f"r.{c}" for c in ("y0", "x0", "h", "w", "top", "left", "th", "tw", "img")])


def parts(frames: DataFrame, d1: int, d2: int, places: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(tile, y0, x0, h, w, t, img): frames cut into places (tile, y0, x0, h, w), which may overlap; a row for each frame of a
    tile. A missing pixel is 0, a null one NaN; frames that are null or empty are left out. Expressions only."""
    whole = (F.size("img") == d1 * d2) & F.forall("img", lambda v: v.isNotNull())
    filled = F.transform(F.sequence(F.lit(0), F.lit(d1 * d2 - 1)), lambda p: F.when(p < F.size("img"), F.coalesce(F.get("img", p), F.lit(float("nan")))).otherwise(F.lit(0.0)))
    rows = []
    for tile, y0, x0, h, w in places:
        numbers = {"tile": tile, "y0": y0, "x0": x0, "h": h, "w": w}
        columns = [F.slice("img", y0 + x * d1 + 1, h) for x in range(x0, x0 + w)]
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in numbers.items()], F.concat(*columns).alias("img")))
    full = frames.where(F.size("img") > 0).select("t", F.col("img").cast("array<double>").alias("img")).select("t", F.when(whole, F.col("img")).otherwise(filled).alias("img"))
    return full.select("t", F.explode(F.array(*rows)).alias("r")).select(*[f"r.{c}" for c in ("tile", "y0", "x0", "h", "w")], "t", "r.img")


def gathered(batches: Iterable[pa.RecordBatch], *names: str, by_pixel: bool = False) -> tuple[list, np.ndarray, np.ndarray]:
    """Of a tile's rows, batch by batch: the values of `names`, which all its rows share, its steps in order, and its movie
    (t, pixels), or (pixels, t) with `by_pixel`. At most two copies of the movie are held, and one at the end."""
    shared, steps, held = [], [], []
    for batch in batches:
        if batch.num_rows:
            shared = shared or [batch.column(c)[0].as_py() for c in names]
            steps.append(batch.column("t").to_numpy(zero_copy_only=False))
            held.append(batch.column("img").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
    t = np.concatenate(steps)
    order = np.argsort(t, kind="stable")
    place, end = np.empty(len(t), dtype=np.int64), len(t)
    place[order] = np.arange(len(t))
    movie = np.empty((held[0].shape[1], end) if by_pixel else (end, held[0].shape[1]))
    while held:
        part = held.pop()
        (movie.T if by_pixel else movie)[place[end - len(part) : end]] = part
        end -= len(part)
    return shared, t[order], movie
