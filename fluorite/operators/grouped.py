"""Kernels over groups: one trace, tile or session in a task; what is in a group is bounded by the recording's tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .tiling import gathered


def deconvolve(traces: DataFrame, g: float | None = None, penalty: float = 0.0) -> DataFrame:
    """Denoised traces and spikes (k, t, c, s) by AR(1) deconvolution; g is estimated for each trace where it isn't given."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        y = frame["v"].to_numpy(dtype=float)
        y = y - np.percentile(y, 15)
        own = g if g is not None else float(np.clip(K.ar_coefficients(y, 1, noise=K.noise_fft(y))[0], 0.0, 0.99))
        c, s = K.oasis_ar1(y, own, penalty)
        return pd.DataFrame({"k": frame["k"], "t": frame["t"], "c": c, "s": s})

    return traces.select("k", "t", "v").groupBy("k").applyInPandas(run, f"k {dict(traces.dtypes)['k']}, t {dict(traces.dtypes)['t']}, c double, s double")


def constrained(traces: DataFrame, order: int = 1) -> DataFrame:
    """(k, t, c, s): denoised traces and the sparsest spikes that leave residuals of the trace's own noise, for
    autoregressive traces of an order that is estimated, as is the noise; the baseline is a low percentile."""
    kind = dict(traces.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t")
        y = frame["v"].to_numpy(dtype=float)
        y = y - np.percentile(y, 15)
        noise = K.noise_fft(y)
        c, s, _ = K.constrained_spikes(y, K.stable_ar(y, order, noise), noise)
        return pd.DataFrame({"k": frame["k"], "t": frame["t"], "c": c, "s": s})

    return traces.select("k", "t", "v").groupBy("k").applyInPandas(run, f"k {kind['k']}, t {kind['t']}, c double, s double")


def trace_statistics(traces: DataFrame, steps: int = 5) -> DataFrame:
    """(k, mode, noise, fitness): half-sample mode, noise from the upper frequencies, and the log-tail event fitness."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("t")["v"].to_numpy(dtype=float)
        return pd.DataFrame({"k": [frame["k"].iloc[0]], "mode": [K.half_sample_mode(x)], "noise": [K.noise_fft(x)], "fitness": [K.event_fitness(x, steps)]})

    return traces.select("k", "t", "v").groupBy("k").applyInPandas(run, f"k {dict(traces.dtypes)['k']}, mode double, noise double, fitness double")


def spikes(traces: DataFrame) -> DataFrame:
    """(k, t) of the spikes of voltage traces, by adaptive template matching."""
    kind = dict(traces.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("t").reset_index(drop=True)
        at = K.spike_times(frame["v"].to_numpy(dtype=float))
        return frame.loc[at, ["k", "t"]]

    return traces.select("k", "t", "v").groupBy("k").applyInPandas(run, f"k {kind['k']}, t {kind['t']}")


def register(frames: DataFrame, template: DataFrame, d1: int, d2: int, most: int) -> DataFrame:
    """(t, dy, dx): each frame's shift onto the template (p, v), to parts of a pixel. The template is one image."""
    image = np.zeros(d1 * d2)
    for r in template.collect():  # one image
        image[r["p"]] = r["v"]
    image = image.reshape(d2, d1).T

    def run(batches):
        for frame in batches:
            found = [K.register(np.asarray(i).reshape(d2, d1).T, image, most) for i in frame["img"]]
            yield pd.DataFrame({"t": frame["t"], "dy": [a for a, _ in found], "dx": [b for _, b in found]})

    return frames.select("t", "img").mapInPandas(run, f"t {dict(frames.dtypes)['t']}, dy double, dx double")


def extract(rows: DataFrame, n: int, reach: int, rounds: int = 10) -> DataFrame:
    """Components of every tile of rows (tile, y0, x0, h, w, t, img), as of tiling.parts: (tile, k,
    y, x, w), by greedy peeling and then refinement.

    A task reads a tile's frames batch by batch and holds its movie twice, so a tile's pixels times its steps bound it. Of
    frames of one step one counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tile, y0, x0, h, w), t, movie = gathered(batches, "tile", "y0", "x0", "h", "w", by_pixel=True)
        last = np.r_[t[1:] != t[:-1], True]
        movie = K.less_median(movie if last.all() else movie[:, last])
        a, c = K.peeled(movie.copy(), h, w, n, reach)
        a, _ = K.hals(movie, a, c, rounds)
        k, p = np.nonzero(a.T > 0)
        columns = [np.full(len(k), tile, np.int32), k.astype(np.int32), y0 + p % h, x0 + p // h, a[p, k]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["tile", "k", "y", "x", "w"])

    return rows.groupBy("tile").applyInArrow(run, "tile int, k int, y long, x long, w double")
