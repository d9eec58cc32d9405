"""Motion correction of movies: frames are mapped in Arrow batches, and only templates, one image, reach the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registration as R


def images(batch: pa.RecordBatch, d1: int, d2: int) -> np.ndarray:
    """The frames of a batch's img column: (n, d1, d2). Null values are NaN."""
    img = batch.column(batch.schema.get_field_index("img"))
    flat = img.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(batch.num_rows, d2, d1).transpose(0, 2, 1)


def lists(frames: np.ndarray) -> pa.Array:
    n = len(frames)
    flat = frames.transpose(0, 2, 1).reshape(n, -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def map_frames(frames: DataFrame, d1: int, d2: int, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """frames with img = change(all frames of a batch as one array). No shuffle."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index("img")
                yield pa.RecordBatch.from_arrays([lists(change(images(batch, d1, d2))) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    kinds = ", ".join(f"{c} {'array<double>' if c == 'img' else k}" for c, k in frames.dtypes)
    return frames.mapInArrow(run, kinds)


def _image(template: DataFrame, d1: int, d2: int) -> np.ndarray:
    out = np.zeros(d1 * d2)
    for r in template.collect():  # one image
        out[r["p"]] = r["v"]
    return out.reshape(d2, d1).T


def template_of(frames: DataFrame, d1: int, d2: int, bins: int = 10) -> np.ndarray:
    """The median over interleaved bins of each bin's mean, pixel by pixel: grouped sums, then one image."""
    pixels = frames.select("t", F.posexplode("img").alias("p", "v"))
    means = pixels.groupBy("p", F.pmod(F.col("t"), F.lit(bins)).alias("b")).agg(F.avg("v").alias("v"))
    return _image(means.groupBy("p").agg(F.percentile("v", 0.5).alias("v")), d1, d2)


def rigid_shifts(frames: DataFrame, template: np.ndarray, d1: int, d2: int, most: float, upsample: int = 10) -> DataFrame:
    """(t, dy, dx): each frame's shift onto the template, to 1 / upsample of a pixel."""
    spectrum = np.fft.fft2(template - template.mean())

    def run(batches):
        for batch in batches:
            found = [R.fine_shift(f, spectrum, most, upsample) for f in images(batch, d1, d2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64())], names=["t", "dy", "dx"])

    return frames.select("t", "img").mapInArrow(run, f"t {dict(frames.dtypes)['t']}, dy double, dx double")


def correct(frames: DataFrame, template: np.ndarray, d1: int, d2: int, most: float, upsample: int = 10) -> DataFrame:
    """Frames moved onto the template; shifts are found and applied in one pass over the frames."""
    spectrum = np.fft.fft2(template - template.mean())
    return map_frames(frames, d1, d2, lambda x: np.stack([R.moved(f, *R.fine_shift(f, spectrum, most, upsample)) for f in x]))


def rigid(frames: DataFrame, d1: int, d2: int, most: float, upsample: int = 10, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Rigid correction: a template from all frames, frames corrected onto it, a better template from those, and so on.

    Returns the corrected frames and the last template. Every round is one pass over the movie and one grouped sum.
    """
    template = template_of(frames, d1, d2)
    for _ in range(rounds - 1):
        template = template_of(correct(frames, template, d1, d2, most, upsample), d1, d2)
    return correct(frames, template, d1, d2, most, upsample), template


def piecewise_shifts(frames: DataFrame, template: np.ndarray, d1: int, d2: int, most: float, size: int, stride: int, deviation: float, upsample: int = 10) -> DataFrame:
    """(t, tile, dy, dx): shifts of overlapping tiles, each near its frame's rigid shift."""
    spectrum = np.fft.fft2(template - template.mean())

    def run(batches):
        for batch in batches:
            t, tile, dy, dx = [], [], [], []
            for at, f in zip(batch.column(0).to_pylist(), images(batch, d1, d2)):
                s = R.tile_shifts(f, template, size, stride, R.fine_shift(f, spectrum, most, upsample), deviation, upsample).reshape(-1, 2)
                t += [at] * len(s)
                tile += range(len(s))
                dy += s[:, 0].tolist()
                dx += s[:, 1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(t, batch.column(0).type), pa.array(tile, pa.int32()), pa.array(dy, pa.float64()), pa.array(dx, pa.float64())], names=["t", "tile", "dy", "dx"])

    return frames.select("t", "img").mapInArrow(run, f"t {dict(frames.dtypes)['t']}, tile int, dy double, dx double")


def correct_piecewise(frames: DataFrame, template: np.ndarray, d1: int, d2: int, most: float, size: int, stride: int, deviation: float, upsample: int = 10) -> DataFrame:
    """Frames whose overlapping tiles are moved each by its own shift and blended."""
    spectrum = np.fft.fft2(template - template.mean())

    def one(f: np.ndarray) -> np.ndarray:
        return R.blended(f, R.tile_shifts(f, template, size, stride, R.fine_shift(f, spectrum, most, upsample), deviation, upsample), size, stride)

    return map_frames(frames, d1, d2, lambda x: np.stack([one(f) for f in x]))


def apply_shifts(frames: DataFrame, shifts: DataFrame, d1: int, d2: int) -> DataFrame:
    """Frames moved by known shifts (t, dy, dx), as of another recording of the same session: one join on t."""
    rows = frames.join(shifts.select("t", "dy", "dx"), "t")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                dy, dx = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                out = np.stack([R.moved(f, a, b) for f, a, b in zip(images(batch, d1, d2), dy, dx)])
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(out)], names=["t", "img"])

    return rows.select("t", "img", "dy", "dx").mapInArrow(run, f"t {dict(frames.dtypes)['t']}, img array<double>")
