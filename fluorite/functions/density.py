"""Densities by diffusion, with a bandwidth that is told from the data, and levels of running percentiles."""

from __future__ import annotations

import math

import numpy as np

BINS = 4096


def cosines(x: np.ndarray) -> np.ndarray:
    """The cosine transform: sums of x at i + 1/2 with cos(pi * k * (i + 1/2) / n), twice."""
    n = len(x)
    return 2 * (np.fft.fft(np.r_[x, np.zeros(n)])[:n] * np.exp(-0.5j * np.pi * np.arange(n) / n)).real


def from_cosines(a: np.ndarray) -> np.ndarray:
    """What cosines() was made from, by its mirrored spectrum."""
    n = len(a)
    half = a * np.exp(0.5j * np.pi * np.arange(n) / n)
    return np.fft.ifft(np.r_[half, 0, np.conj(half[:0:-1])]).real[:n]


def stage(t: float, squares: np.ndarray, count: float, first: int = 7) -> float:
    """The squared bandwidth that plug-in estimates of ever lower derivatives give, when the highest is smoothed by t.
    squares: of the density's cosine coefficients, halved."""
    k2 = np.arange(1, len(squares) + 1, dtype=float) ** 2

    def roughness(s: int, time: float) -> float:
        with np.errstate(under="ignore"):
            return 2 * math.pi ** (2 * s) * float((np.exp(s * np.log(k2) - k2 * math.pi**2 * time) * squares).sum())

    f = roughness(first, t)
    for s in range(first - 1, 1, -1):
        if not f > 0:
            return math.inf
        odd = math.prod(range(1, 2 * s, 2)) / math.sqrt(2 * math.pi)
        f = roughness(s, (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / count / f) ** (2 / (3 + 2 * s)))
    return (2 * count * math.sqrt(math.pi) * f) ** -0.4 if f > 0 else math.inf


def density(x: np.ndarray, bins: int = BINS) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(bandwidth, places, density) of a sample, on a tenth more than its range at either end. The bandwidth is the fixed
    point of stage(), found by halving; None for fewer than two different values or where there is no fixed point."""
    x = np.asarray(x, dtype=float)
    x = x[np.isfinite(x)]
    if len(x) < 2 or x.min() == x.max():
        return None
    wide = x.max() - x.min()
    low, high = x.min() - wide / 10, x.max() + wide / 10
    counts, edges = np.histogram(x, bins, (low, high))
    a = cosines(counts / len(x))
    squares = (a[1:] / 2) ** 2
    off = lambda t: t - stage(t, squares, len(x))
    under, over = 0.0, 0.1
    if not off(over) > 0:
        return None
    for _ in range(60):
        middle = (under + over) / 2
        under, over = (under, middle) if off(middle) > 0 else (middle, over)
    t = (under + over) / 2
    smooth = from_cosines(a * np.exp(-((np.arange(bins) * np.pi) ** 2) * t / 2))
    places = (edges[1:] + edges[:-1]) / 2
    return math.sqrt(t) * (high - low), places, smooth / (smooth.sum() * (places[1] - places[0]))


def mode_level(x: np.ndarray, bins: int = BINS) -> tuple[float, float, float]:
    """(bandwidth, mode, level): the place of a sample's highest density, and the share of it below that, in per cent. A
    sample without a density has its median, at 50."""
    found = density(x, bins)
    x = np.asarray(x, dtype=float)
    x = x[np.isfinite(x)]
    if found is None:
        return 0.0, float(np.median(x)) if len(x) else math.nan, 50.0
    width, places, d = found
    top = int(d.argmax())
    level = float(np.cumsum(d)[top] * (places[1] - places[0]) * 100)
    return width, float(places[top]), level if 0 <= level <= 100 else 50.0


def running_level(x: np.ndarray, reach: int, level: float) -> np.ndarray:
    """The percentile of what lies within `reach` steps of each step, cut at the ends."""
    n = len(x)
    if not n:
        return np.zeros(0)
    reach = min(reach, n)
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(x, dtype=float), reach, constant_values=np.nan), 2 * reach + 1)
    step = max(1, (1 << 22) // (2 * reach + 1))
    out = []
    for at in range(0, n, step):
        part = np.sort(wide[at : at + step], axis=1)  # NaN last
        have = (~np.isnan(part)).sum(axis=1)
        place = level / 100 * (have - 1)
        i = np.floor(place).astype(int)
        rows = np.arange(len(part))
        a, b = part[rows, i], part[rows, np.minimum(i + 1, have - 1)]
        out.append(a + (b - a) * (place - i))
    return np.concatenate(out)
