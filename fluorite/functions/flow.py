"""Dense motion between two images: both are told as quadratics around every pixel, and those are moved onto each other."""

from __future__ import annotations

import numpy as np

from .warps import interpolated, warped


def _along(x: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Sums of weights times neighbours along an axis; the border is repeated."""
    reach = len(weights) // 2
    pad = [(reach, reach) if i == axis else (0, 0) for i in range(x.ndim)]
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="edge"), len(weights), axis=axis) @ weights


def quadratics(x: np.ndarray, reach: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(A, b): around each pixel, with Gaussian weights, the image is about d' A d + b' d and a constant, d = (dy, dx)."""
    o = np.arange(-reach, reach + 1, dtype=float)
    g = np.exp(-((o / sigma) ** 2) / 2)
    powers = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    rows = {i: _along(x, g * o**i, 0) for i in range(3)}
    seen = np.stack([_along(rows[i], g * o**j, 1) for i, j in powers], axis=-1)
    m = [float((g * o**i).sum()) for i in range(5)]
    gram = np.array([[m[a + c] * m[b + d] for c, d in powers] for a, b in powers])
    r = seen @ np.linalg.inv(gram).T
    return np.stack([np.stack([r[..., 3], r[..., 5] / 2], -1), np.stack([r[..., 5] / 2, r[..., 4]], -1)], -2), r[..., 1:3]


def _solved(a: np.ndarray, change: np.ndarray, window: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The motion d of least |a d - change|^2 over a window around each pixel; `otherwise` where nothing can be told."""
    g, h = np.einsum("yxki,yxkj->yxij", a, a), np.einsum("yxki,yxk->yxi", a, change)
    g, h = (_along(_along(v, window, 0), window, 1) for v in (g, h))
    det = g[..., 0, 0] * g[..., 1, 1] - g[..., 0, 1] ** 2
    trace = g[..., 0, 0] + g[..., 1, 1]
    known = det > 1e-9 * np.maximum(trace.max(), 1e-300) ** 2
    out = np.stack([g[..., 1, 1] * h[..., 0] - g[..., 0, 1] * h[..., 1], g[..., 0, 0] * h[..., 1] - g[..., 0, 1] * h[..., 0]], -1)
    return np.where(known[..., None], out / np.where(known, det, 1.0)[..., None], otherwise)


def _step(one: tuple, two: tuple, d: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A better motion from the one so far, by what the quadratics' shift says."""
    size = d.shape[:2]
    there = warped(np.concatenate([two[0].reshape(*size, 4), two[1]], axis=-1), -d)  # all channels at once
    a = (one[0] + there[..., :4].reshape(*size, 2, 2)) / 2
    return _solved(a, (one[1] - there[..., 4:]) / 2 + np.einsum("yxij,yxj->yxi", a, d), window, d)


def _refined(one: tuple, two: np.ndarray, d: np.ndarray, window: np.ndarray, reach: int, sigma: float) -> np.ndarray:
    """The motion and what is left of it when image two is warped back, so that what turns is turned too; pixels that come
    from outside don't count."""
    back = warped(two, -d, np.nan)
    inside = np.isfinite(back)
    rest = quadratics(np.where(inside, back, warped(two, -d)), reach, sigma)
    far = _along(_along(inside.astype(float), np.ones(2 * reach + 1), 0), np.ones(2 * reach + 1), 1) > (2 * reach + 1) ** 2 - 0.5
    return d + _solved((one[0] + rest[0]) / 2 * far[..., None, None], (one[1] - rest[1]) / 2 * far[..., None], window, np.zeros_like(d))


def _halved(x: np.ndarray) -> np.ndarray:
    g = np.array([1.0, 4, 6, 4, 1]) / 16
    return _along(_along(x, g, 0), g, 1)[::2, ::2]


def motion(one: np.ndarray, two: np.ndarray, levels: int = 3, reach: int = 4, sigma: float = 1.5, window: int = 7, rounds: int = 4, refine: int = 2) -> np.ndarray:
    """(d1, d2, 2): the motion (dy, dx) of each pixel from image one to image two, two(p + d) = one(p), coarse to fine:
    found on images of half the size first, as long as they have room for the window, and refined on the whole ones."""
    size = one.shape
    d = np.zeros((*size, 2))
    if levels > 1 and min(size) >= 4 * window:
        small = 2 * motion(_halved(one), _halved(two), levels - 1, reach, sigma, window, rounds, 0)
        d = interpolated(small, [np.arange(n, dtype=float) * 2 for n in small.shape[:2]], [np.arange(n, dtype=float) for n in size])
    o = np.arange(-window, window + 1)
    weights = np.exp(-((o / (window / 2)) ** 2) / 2)
    weights /= weights.sum()
    a, b = quadratics(one, reach, sigma), quadratics(two, reach, sigma)
    for _ in range(rounds):
        d = _step(a, b, d, weights)
    for _ in range(refine):
        d = _refined(a, two, d, weights, reach, sigma)
    return d
