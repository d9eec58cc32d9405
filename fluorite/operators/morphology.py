"""Connected labels over tiles, morphology and peaks of frames, and masks of components.

frames: t, img; tiles: image, y0, x0, d1, d2, img with a tile's own pixels in column-major order, as of a frame `height`
pixels high; p = y + x * height counts in the whole frame.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import morphology as MO
from ..sources.tables import stored
from .matching import blocks
from .motion import map_frames
from .tiling import tiled


def morphed(frames: DataFrame, d1: int, d2: int, what: str, reach: int = 1) -> DataFrame:
    """Frames dilated, eroded, opened or closed by squares of 2 * reach + 1 pixels; what is outside doesn't count."""
    change = {"dilate": MO.dilate, "erode": MO.erode, "open": MO.opened, "close": MO.closed}[what]
    return map_frames(frames, d1, d2, lambda x: np.stack([change(f, reach) for f in x]))


def distances(frames: DataFrame, d1: int, d2: int, level: float) -> DataFrame:
    """Frames of the distance of each pixel over a level to the nearest that isn't; infinite where none is."""
    return map_frames(frames, d1, d2, lambda x: np.stack([MO.distance(f > level) for f in x]))


def peaks(frames: DataFrame, dims: tuple[int, ...], apart: int = 1, least: float | None = None, share: float | None = None, border: int | None = None, most: int | None = None) -> DataFrame:
    """(t, rank, p, v): the local maxima of each image or volume, the highest first. Null frames have none."""
    kind = dict(frames.dtypes)["t"]

    def run(batches):
        for batch in batches:
            t, rank, place, value = [], [], [], []
            for at, img in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not img.is_valid:
                    continue
                x = img.values.to_numpy(zero_copy_only=False).astype(float).reshape(dims, order="F")
                found = MO.peaks(x, apart, least, share, border, most)
                t += [at] * len(found)
                rank += range(1, len(found) + 1)
                place += np.ravel_multi_index(tuple(found.T), dims, order="F").tolist() if len(found) else []
                value += x[tuple(found.T)].tolist() if len(found) else []
            yield pa.RecordBatch.from_arrays([pa.array(t, batch.column(0).type), pa.array(rank, pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.float64())], names=["t", "rank", "p", "v"])

    return frames.select("t", "img").mapInArrow(run, f"t {kind}, rank int, p int, v double")


def cut(frames: DataFrame, d1: int, d2: int, size: int) -> DataFrame:
    """(image, y0, x0, d1, d2, img): frames, named by t, cut into tiles of size by size pixels, the last ones smaller."""
    return tiled(frames.select(F.lit(0).alias("session"), "t", "img"), d1, d2, size).select(F.col("t").alias("image"), "y0", "x0", "d1", "d2", "img")


def labels(tiles: DataFrame, height: int, level: float, diagonal: bool = False) -> DataFrame:
    """(image, p, label): pixels over a level, with the smallest p of all that they are connected with, over tiles too.

    Tiles are labelled apart, each in its task; only pixels on tiles' rims are joined with their neighbours, and only the
    labels that meet there are connected. Null and NaN values are not over a level.
    """
    kind = dict(tiles.dtypes)["image"]

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for image, y0, x0, d1, d2, img in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5)):
                if not img.is_valid:
                    continue
                x = img.values.to_numpy(zero_copy_only=False).astype(float).reshape((d1, d2), order="F")
                own = MO.label(x > level, diagonal)
                y, c = np.nonzero(own >= 0)
                name = own[y, c]
                for column, values in zip(out, ([image] * len(y), (y0 + y + (x0 + c) * height).tolist(), (y0 + name % d1 + (x0 + name // d1) * height).tolist(), ((y == 0) | (y == d1 - 1) | (c == 0) | (c == d2 - 1)).tolist())):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())], names=["image", "p", "label", "rim"])

    found = stored(tiles.select("image", "y0", "x0", "d1", "d2", "img").mapInArrow(run, f"image {kind}, p long, label long, rim boolean"))
    rim = found.where("rim").select("image", "p", "label")
    y = F.pmod(F.col("p"), F.lit(height))
    near = [F.when(F.lit(dy == 0) | ((y + dy >= 0) & (y + dy < height)), F.col("p") + dy + dx * height) for dy, dx in [(s[1], s[0]) for s in MO.offsets(2, diagonal)]]
    asked = rim.select(F.col("image").alias("i"), F.col("label").alias("a"), F.explode(F.array(*near)).alias("q")).where("q is not null")
    meet = asked.join(rim.hint("merge"), (F.col("i") == rim["image"]) & (F.col("q") == rim["p"])).where("a <> label").select("image", "a", F.col("label").alias("b")).distinct()
    side = lambda c: F.struct("image", F.col(c).alias("label"))
    edge = F.struct("image", "a", "b")
    joined = blocks(meet.select(side("a").alias("k1"), edge.alias("k2")).unionByName(meet.select(side("b").alias("k1"), edge.alias("k2"))))
    least = joined.groupBy("block").agg(F.min("k1.label").alias("least"))
    names = joined.join(least.hint("merge"), "block").select("k1.image", F.col("k1.label").alias("label"), "least")
    return found.join(names.hint("merge"), ["image", "label"], "left").select("image", "p", F.coalesce("least", "label").alias("label"))


def _near(at: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with their gaps cut to `apart` empty rows, and the first place of what each row then stands for."""
    held = np.unique(at)
    place = np.r_[0, np.cumsum(np.minimum(np.diff(held), apart + 1))].astype(np.int64)
    rows = np.arange(place[-1] + 1)
    last = np.searchsorted(place, rows, side="right") - 1
    return place[np.searchsorted(held, at)], held[last] + rows - place[last]


def shaped(a: DataFrame, d1: int, change: Callable[..., np.ndarray], apart: int = 6) -> DataFrame:
    """Footprints (k, p, w) after a change of each one's image, in the box of its pixels.

    Rows and columns without a pixel count as at most `apart`, so an image grows with a footprint's pixels and not with how
    far they lie from each other; a change must not look over so wide a gap. One that has a parameter `at` gets there where
    the image's rows and columns lie. What it sets must be pixels of the footprint.
    """
    kinds, placed = dict(a.dtypes), "at" in inspect.signature(change).parameters

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        y, rows = _near(frame["p"].to_numpy() % d1, apart)
        x, columns = _near(frame["p"].to_numpy() // d1, apart)
        image = np.zeros((len(rows), len(columns)))
        image[y, x] = frame["w"].to_numpy(dtype=float)
        out = change(image, at=(rows, columns)) if placed else change(image)
        y, x = np.nonzero(out)
        return pd.DataFrame({"k": [frame["k"].iloc[0]] * len(y), "p": rows[y] + columns[x] * d1, "w": out[y, x]})

    return a.where("w is not null").select("k", "p", "w").groupBy("k").applyInPandas(run, f"k {kinds['k']}, p {kinds['p']}, w double")


def masks_of(frames: DataFrame, dims: tuple[int, int], radius: int, least: int, hole: int) -> DataFrame:
    """(k, p): what a movie of structure shows in its mean image, one grouped sum and one image in a task; k is the first
    pixel of each."""
    pixels = frames.select(F.posexplode("img").alias("p", "v"))
    mean = pixels.groupBy("p").agg(F.avg("v").alias("v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("img"))

    def run(batches):
        for batch in batches:
            for img in batch.column(0):
                if img.is_valid and len(img.values):
                    found = MO.masks(img.values.to_numpy(zero_copy_only=False).astype(float).reshape(dims, order="F"), radius, least, hole).ravel(order="F")
                    p = np.flatnonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[p].astype(np.int64)), pa.array(p.astype(np.int64))], names=["k", "p"])

    return mean.mapInArrow(run, "k long, p long")
