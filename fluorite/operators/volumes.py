"""Registration of movies of volumes, or of images, by Arrow batches: rigid shifts, fields of shifts, warps.

frames: t, img ARRAY<DOUBLE> with img in column-major order, p = y + x * d1 + z * d1 * d2. Only a template, one volume,
reaches the driver and the tasks. A pixel that a frame has no number for takes the template's; a frame that is null or of
another size has no shift (nulls) and is passed on as it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import warps as W

AXES = ("dy", "dx", "dz")


def template_of(frames: DataFrame, dims: tuple[int, ...], bins: int = 10) -> np.ndarray:
    """The median over interleaved bins of each bin's mean, pixel by pixel: grouped sums, then one volume."""
    pixels = frames.select("t", F.posexplode("img").alias("p", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    means = pixels.groupBy("p", F.pmod(F.col("t"), F.lit(bins)).alias("b")).agg(F.avg("v").alias("v"))
    out = np.zeros(int(np.prod(dims)))
    for r in means.groupBy("p").agg(F.percentile("v", 0.5).alias("v")).where(F.col("p") < len(out)).collect():  # one volume
        out[r["p"]] = r["v"]
    return out.reshape(dims, order="F")


def _volume(img: list | None, dims: tuple[int, ...]) -> np.ndarray | None:
    if img is None or len(img) != int(np.prod(dims)):
        return None
    return np.array(img, dtype=float).reshape(dims, order="F")


def _mapped(frames: DataFrame, dims: tuple[int, ...], out: str, row: Callable[..., list], once: Callable[[], list] | None = None) -> DataFrame:
    """(t, columns of `out`) with row(volume) of each frame, or row(volume, once()) with what a task makes once. No shuffle."""
    kind = dict(frames.dtypes)["t"]
    names = ["t", *[c.strip().split(" ")[0] for c in out.split(",")]]
    kinds = [pa.list_(pa.float64()) if "array<double>" in c else pa.float64() for c in out.split(",")]

    def run(batches):
        fixed = (once(),) if once else ()
        for batch in batches:
            found = [row(_volume(img.as_py(), dims), *fixed) for img in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]], names=names)

    return frames.select("t", "img").mapInArrow(run, f"t {kind}, {out}")


def _shift_columns(dims: tuple[int, ...]) -> str:
    return ", ".join(f"{a} double" for a in AXES[: len(dims)])


def shifts(frames: DataFrame, template: np.ndarray, most, upsample: int = 10) -> DataFrame:
    """(t, dy, dx[, dz]): each frame's shift onto the template, to 1 / upsample of a pixel, at most `most` along each axis."""
    spectrum = W.spectrum(template)

    def row(v):
        return [None] * template.ndim if v is None else (W.peak_shift(W.filled(v, template), spectrum, most, upsample) + 0.0).tolist()

    return _mapped(frames, template.shape, _shift_columns(template.shape), row)


def correct(frames: DataFrame, template: np.ndarray, most, upsample: int = 10, border: float | None = None) -> DataFrame:
    """(t, img): frames moved onto the template as a whole; shifts are found and applied in one pass."""
    spectrum = W.spectrum(template)

    def row(v):
        if v is None:
            return [None]
        known = W.filled(v, template)
        return [W.shifted(known, W.peak_shift(known, spectrum, most, upsample), border).ravel(order="F")]

    return _mapped(frames, template.shape, "img array<double>", row)


def tile_shifts(frames: DataFrame, template: np.ndarray, most, sizes, strides, deviation: float, upsample: int = 10) -> DataFrame:
    """(t, tile, dy, dx[, dz]): the shifts of overlapping tiles, each within `deviation` of its frame's; tiles count along
    the last axis first."""
    spectrum, dims = W.spectrum(template), template.shape

    def row(v, tiles):
        if v is None:
            return [None]
        known = W.filled(v, template)
        return [W.tile_field(known, template, sizes, strides, W.peak_shift(known, spectrum, most, upsample), deviation, upsample, known=tiles).ravel()]

    flat = _mapped(frames, dims, "s array<double>", row, lambda: W.tiles_of(template, sizes, strides))
    n = len(dims)
    each = F.posexplode(F.transform(F.sequence(F.lit(0), (F.size("s") / n).cast("int") - 1), lambda i: F.slice("s", i * n + 1, n)))
    return flat.select("t", each.alias("tile", "s")).select("t", "tile", *[F.get("s", F.lit(i)).alias(a) for i, a in enumerate(AXES[:n])])


def warp(frames: DataFrame, template: np.ndarray, most, sizes, strides, deviation: float, upsample: int = 10) -> DataFrame:
    """(t, img): frames warped onto the template: the tiles' shifts are interpolated to a shift for every pixel."""
    spectrum = W.spectrum(template)

    def row(v, tiles):
        return [None if v is None else W.piecewise(v, template, spectrum, most, sizes, strides, deviation, upsample, tiles)[0].ravel(order="F")]

    return _mapped(frames, template.shape, "img array<double>", row, lambda: W.tiles_of(template, sizes, strides))


def aligned(frames: DataFrame, dims: tuple[int, ...], most, sizes, strides, deviation: float, upsample: int = 10, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Frames warped onto a template that gets better: of all frames, of the frames moved onto it, and of warped ones.
    Every round is one pass over the movie and one grouped sum."""
    template = template_of(frames, dims)
    template = template_of(correct(frames, template, most, upsample), dims)
    for _ in range(rounds - 1):
        template = template_of(warp(frames, template, most, sizes, strides, deviation, upsample), dims)
    return warp(frames, template, most, sizes, strides, deviation, upsample), template
