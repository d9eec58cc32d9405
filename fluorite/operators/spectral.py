"""Noise of traces from their spectra, and principal and independent components of a movie."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectra
from .motion import map_frames


def welch_noise(traces: DataFrame, method: str = "logmexp", low: float = 0.25, high: float = 0.5) -> DataFrame:
    """(k, noise) of traces (k, t, v), from the densities of frequencies `low` to `high` of the sampling rate; whole traces,
    one in a group. method: mean, median or logmexp."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        at, power = spectra.welch(frame.sort_values("t")["v"].to_numpy(dtype=float))
        use = (at >= low) & (at <= high)
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "noise": [spectra.level(power[use], method) if use.any() else 0.0]})

    return traces.select("k", "t", "v").groupBy("k").applyInPandas(run, f"k {dict(traces.dtypes)['k']}, noise double")


def _mean(frames: DataFrame) -> tuple[np.ndarray, int]:
    """The mean image, values that are missing left out, and the number of frames."""
    pixels = frames.select(F.posexplode("img").alias("p", "v"))
    known = F.when(~F.isnan("v"), F.col("v"))
    rows = pixels.groupBy("p").agg(F.avg(known).alias("v")).orderBy("p").collect()  # one image
    return np.array([0.0 if r["v"] is None else r["v"] for r in rows]), frames.where("img is not null").count()


def _centred(img: pa.Array, mean: np.ndarray) -> np.ndarray:
    """Frames less the mean image; what a frame has no number for is the mean's."""
    x = img.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(mean)) - mean
    return np.where(np.isfinite(x), x, 0.0)


def _times(frames: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum over frames of y y' q, y a frame less the mean: each task sums its frames, a number for each pixel and
    column of q; then tasks are summed."""
    width = q.shape[1]

    def run(batches):
        total = np.zeros(q.shape)
        for batch in batches:
            y = _centred(batch.column(0), mean)
            total += y.T @ (y @ q)
        z = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * width), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(q), dtype=np.int32)), z], names=["p", "z"])

    parts = frames.where("img is not null").select("img").mapInArrow(run, "p int, z array<double>")
    sums = parts.groupBy("p").agg(*[F.sum(F.get("z", F.lit(i))).alias(f"z{i}") for i in range(width)])
    out = np.zeros(q.shape)
    for r in sums.collect():  # one image for each column
        out[r["p"]] = r[1:]
    return out


def _axes(frames: DataFrame, n: int, more: int = 4, blocks: int = 6, passes: int = 60, close: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean image, the n axes of most variance and their variances.

    A block of images is multiplied by the covariance again and again, one pass over the movie each, without it ever being
    made; the axes are the best ones in what all blocks span, taken when they change by no more than `close` of the largest
    variance. After `blocks` blocks the best images begin anew. What reaches the driver is some images, whatever the time.
    """
    mean, count = _mean(frames)
    if not len(mean) or not count:
        return mean, np.zeros((0, len(mean))), np.zeros(0)
    width = min(len(mean), n + more)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((len(mean), width)))[0]
    basis, seen = np.zeros((len(mean), 0)), np.zeros((len(mean), 0))
    for _ in range(passes):
        basis, seen = np.hstack([basis, q]), np.hstack([seen, _times(frames, mean, q) / count])
        small = basis.T @ seen
        size, turn = np.linalg.eigh((small + small.T) / 2)
        best = turn[:, ::-1][:, :width]
        axes, moved = basis @ best, seen @ best
        size = size[::-1][:width]
        left = moved - axes * size
        if np.linalg.norm(left[:, :n], axis=0).max() <= close * max(size[0], 1e-300):
            break
        if basis.shape[1] + width > blocks * width:
            basis, seen = axes, moved  # their products are known
        new = left - basis @ (basis.T @ left)
        new = new - basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        q = q[:, abs(np.diag(r)) > 1e-12 * max(size[0], 1e-300)]
        q = q - basis @ (basis.T @ q)
        if not q.shape[1] or basis.shape[1] + q.shape[1] > len(mean):
            q = q[:, : len(mean) - basis.shape[1]]
            if not q.shape[1]:
                break
        q = np.linalg.qr(q)[0]
    axes = axes[:, :n].T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]  # the largest weight is positive
    return mean, axes, np.maximum(size[:n], 0.0)


def principal(frames: DataFrame, n: int) -> DataFrame:
    """(k, t, v): each frame's place along the n axes of most variance. Axes go to the tasks; frames aren't shuffled."""
    mean, axes, _ = _axes(frames, n)
    kind = dict(frames.dtypes)["t"]

    def run(batches):
        for batch in batches:
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(axes)))
            k = pa.array(np.tile(np.arange(len(axes), dtype=np.int32), batch.num_rows))
            yield pa.RecordBatch.from_arrays([k, batch.column(0).take(at), pa.array((_centred(batch.column(1), mean) @ axes.T).ravel())], names=["k", "t", "v"])

    return frames.where("img is not null").select("t", "img").mapInArrow(run, f"k int, t {kind}, v double")


def denoised(frames: DataFrame, d1: int, d2: int, n: int) -> DataFrame:
    """Frames as their mean and n axes of most variance tell them."""
    mean, axes, _ = _axes(frames, n)

    def change(movie: np.ndarray) -> np.ndarray:
        flat = movie.transpose(0, 2, 1).reshape(len(movie), -1) - mean
        return (flat @ axes.T @ axes + mean).reshape(len(movie), d2, d1).transpose(0, 2, 1)

    return map_frames(frames, d1, d2, change)


def _even(w: np.ndarray) -> np.ndarray:
    """Rows made orthogonal, none before another."""
    u, _, v = np.linalg.svd(w, full_matrices=False)
    return u @ v


def independent(frames: DataFrame, n: int, k: int | None = None, space: float = 1.0, rounds: int = 200, close: float = 1e-7) -> DataFrame:
    """(k, p, v): images of k independent components among the n axes of most variance.

    Rows of features are pixels, by their places along the axes times `space`, and steps, by theirs times 1 - space; a
    rotation is sought that makes features as little alike a normal distribution as can be (log cosh), by fixed points,
    all components at once. With space = 1 pixels alone count. Steps are summed where they lie, in one pass for each round:
    k by n numbers. Components are ordered by how peaked their images are; the largest value of each is positive.
    """
    spark = frames.sparkSession
    mean, axes, size = _axes(frames, n)
    use = size > 1e-10 * max(size.max(initial=0.0), 1e-300)
    axes, size = axes[use], size[use]
    n, k = len(axes), min(k or n, len(axes))
    if not k:
        return spark.createDataFrame([], "k int, p int, v double")
    count = frames.where("img is not null").count()
    images = axes.T * np.sqrt(size * count)
    top = images.max() or 1.0
    rows = space / top * (images - images.mean(axis=0))
    steps = (1 - space) / top  # of the unit courses, which sum to 0 and are orthogonal
    total = len(rows) + count
    variance, turn = np.linalg.eigh((rows.T @ rows + steps**2 * np.eye(n)) / total)
    white = (turn / np.sqrt(variance))[:, ::-1][:, :k]
    rows = rows @ white
    course = axes.T / np.sqrt(size * count) * steps @ white

    def moments(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.tanh(rows @ w.T)
        out, bend = g.T @ rows, (1 - g * g).sum(axis=0)
        if steps == 0:
            return out, bend + count

        def run(batches):
            a, b = np.zeros((k, k)), np.zeros(k)
            for batch in batches:
                x = _centred(batch.column(0), mean) @ course
                h = np.tanh(x @ w.T)
                a += h.T @ x
                b += (1 - h * h).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.r_[a.ravel(), b])], names=["i", "s"])

        sums = frames.where("img is not null").select("img").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        s = np.array([r["s"] for r in sums]) if sums else np.zeros(k * k + k)
        return out + s[: k * k].reshape(k, k), bend + s[k * k :]

    w = _even(np.random.default_rng(1).standard_normal((k, k)))
    for _ in range(rounds):
        out, bend = moments(w)
        new = _even(out / total - (bend / total)[:, None] * w)
        change = abs(abs((new * w).sum(axis=1)) - 1).max()
        w = new
        if change < close:
            break
    found = (rows @ w.T).T
    found = found * np.sign(found[np.arange(k), abs(found).argmax(axis=1)])[:, None]
    peaked = (found**4).mean(axis=1) / np.maximum((found**2).mean(axis=1) ** 2, 1e-300)
    found = found[np.argsort(-peaked, kind="stable")]
    at, p = np.divmod(np.arange(found.size), found.shape[1])
    table = pa.table([pa.array(at.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(found.ravel())], names=["k", "p", "v"])
    return spark.createDataFrame(table)  # some images
