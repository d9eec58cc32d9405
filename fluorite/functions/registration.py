"""Kernels of motion correction on one frame: shifts to parts of a pixel, their application, and tiles that are blended."""

from __future__ import annotations

import numpy as np


def _grid(d: int) -> np.ndarray:
    return np.fft.fftfreq(d)


def fine_shift(frame: np.ndarray, template_spectrum: np.ndarray, most: float, upsample: int = 10, around: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
    """The shift (dy, dx) that moves `frame` onto a template of this spectrum: the whole-pixel peak of the
    cross-correlation, then its finest point on a grid `upsample` times as dense, by a small direct transform.

    Shifts are at most `most` away from `around`.
    """
    d1, d2 = frame.shape
    cross = np.conj(np.fft.fft2(frame - frame.mean())) * template_spectrum
    whole = np.fft.ifft2(cross).real
    dy, dx = np.fft.fftfreq(d1, 1 / d1), np.fft.fftfreq(d2, 1 / d2)
    allowed = (abs(dy - around[0]) <= most)[:, None] & (abs(dx - around[1]) <= most)[None, :]
    if not allowed.any():
        return around
    i, j = np.unravel_index(np.where(allowed, whole, -np.inf).argmax(), whole.shape)
    if upsample <= 1:
        return float(dy[i]), float(dx[j])
    near = np.arange(-upsample, upsample + 1) / upsample
    ys, xs = np.clip(dy[i] + near, around[0] - most, around[0] + most), np.clip(dx[j] + near, around[1] - most, around[1] + most)
    rows, columns = np.exp(2j * np.pi * np.outer(ys, _grid(d1))), np.exp(2j * np.pi * np.outer(_grid(d2), xs))
    a, b = np.unravel_index((rows @ cross @ columns).real.argmax(), (len(ys), len(xs)))
    return float(ys[a]), float(xs[b])


def moved(frame: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """The frame moved by parts of a pixel in its spectrum; what wraps around takes the nearest value that didn't."""
    d1, d2 = frame.shape
    phase = np.exp(-2j * np.pi * (dy * _grid(d1)[:, None] + dx * _grid(d2)[None, :]))
    out = np.fft.ifft2(np.fft.fft2(frame) * phase).real
    top, left = int(np.ceil(max(dy, 0))), int(np.ceil(max(dx, 0)))
    low, right = d1 - int(np.ceil(max(-dy, 0))), d2 - int(np.ceil(max(-dx, 0)))
    if top >= low or left >= right:
        return np.full_like(out, frame.mean())
    y, x = np.clip(np.arange(d1), top, low - 1), np.clip(np.arange(d2), left, right - 1)
    return out[np.ix_(y, x)]


def tile_starts(d: int, size: int, stride: int) -> list[int]:
    return sorted({*range(0, max(d - size, 0) + 1, stride), max(d - size, 0)})


def tile_shifts(frame: np.ndarray, template: np.ndarray, size: int, stride: int, rigid: tuple[float, float], deviation: float, upsample: int = 10) -> np.ndarray:
    """(rows, columns, 2): each overlapping tile's shift, at most `deviation` away from the frame's rigid one."""
    ys, xs = tile_starts(frame.shape[0], size, stride), tile_starts(frame.shape[1], size, stride)
    out = np.zeros((len(ys), len(xs), 2))
    for i, y in enumerate(ys):
        for j, x in enumerate(xs):
            part = template[y : y + size, x : x + size]
            out[i, j] = fine_shift(frame[y : y + size, x : x + size], np.fft.fft2(part - part.mean()), deviation, upsample, rigid)
    return out


def blended(frame: np.ndarray, shifts: np.ndarray, size: int, stride: int) -> np.ndarray:
    """The frame with every tile moved by its own shift; where tiles overlap, weights fall linearly from their middles."""
    d1, d2 = frame.shape
    ys, xs = tile_starts(d1, size, stride), tile_starts(d2, size, stride)
    h, w = min(size, d1), min(size, d2)
    ramp = lambda n: 1.0 + np.minimum(np.arange(n), np.arange(n)[::-1])
    weight = np.outer(ramp(h), ramp(w))
    total, whole = np.zeros((d1, d2)), np.zeros((d1, d2))
    done: dict[tuple[float, float], np.ndarray] = {}
    for i, y in enumerate(ys):
        for j, x in enumerate(xs):
            key = tuple(shifts[i, j])
            if key not in done:
                done[key] = moved(frame, *key)
            total[y : y + h, x : x + w] += weight * done[key][y : y + h, x : x + w]
            whole[y : y + h, x : x + w] += weight
    return total / whole
