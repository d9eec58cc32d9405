"""Components on a strong background, from seeds where a filtered movie is correlated and rises over its noise."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .morphology import connected, falling

#: Steps of a movie that are filtered at a time.
_STEPS = 4096


@dataclass(frozen=True)
class Seeding:
    """sigma: a component's Gaussian width; diameter: its reach; a seed's least correlation with its neighbours and least
    peak over noise; level: filtered values under so many times the noise count as nothing for correlations; most:
    components of a field at most, None for all that pass."""

    sigma: float = 2.0
    diameter: int = 9
    min_corr: float = 0.7
    min_pnr: float = 6.0
    level: float = 3.0
    own: float = 0.9
    outside: float = 0.3
    least_pixels: int = 3
    most: int | None = None

    @property
    def reach(self) -> int:
        """Pixels that the filter looks away."""
        return int(np.ceil(2 * self.sigma))

    @property
    def halo(self) -> int:
        """Pixels around a tile that its components depend on: those of seeds up to a diameter away, and their filters."""
        return self.diameter + self.diameter // 2 + self.reach + 3


def _side(d: int, weights: np.ndarray) -> np.ndarray:
    """A filter along a side as a matrix; the border is repeated outwards."""
    reach = len(weights) // 2
    out = np.zeros((d, d))
    for o, w in zip(range(-reach, reach + 1), weights):
        np.add.at(out, (np.arange(d), np.clip(np.arange(d) + o, 0, d - 1)), w)
    return out


def high_pass(x: np.ndarray, s: Seeding) -> np.ndarray:
    """Images (..., d1, d2) less what is smooth: a Gaussian less the mean of its square."""
    o = np.arange(-s.reach, s.reach + 1)
    near = np.exp(-((o / s.sigma) ** 2) / 2)
    near, wide = near / near.sum(), np.full(len(o), 1 / len(o))
    d1, d2 = x.shape[-2:]
    sides = _side(d1, near), _side(d2, near).T, _side(d1, wide), _side(d2, wide).T
    if x.ndim < 3:
        return sides[0] @ x @ sides[1] - sides[2] @ x @ sides[3]
    out = np.empty(x.shape)
    for i in range(0, len(x), _STEPS):
        some = x[i : i + _STEPS]
        out[i : i + _STEPS] = sides[0] @ some @ sides[1] - sides[2] @ some @ sides[3]
    return out


def noise(x: np.ndarray) -> np.ndarray:
    """The noise of each pixel of a movie (t, d1, d2) from the upper half of its frequencies."""
    n = len(x)
    band = np.arange(n // 2 + 1) / n
    use = (band > 0.25) & (band <= 0.5)
    out = np.zeros(x.shape[1:])
    if use.any():
        for p in np.ndindex(out.shape):
            out[p] = np.sqrt((abs(np.fft.rfft(x[:, *p])[use]) ** 2 / n).mean())
    return out


def peak_to_noise(x: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    return (x.max(axis=0) - _median(x)) / np.where(sigma > 0, sigma, np.inf)


def _median(x: np.ndarray) -> np.ndarray:
    """Of each pixel; a pixel's trace at a time, as np.median copies what it gets."""
    out = np.empty(x.shape[1:])
    for p in np.ndindex(out.shape):
        out[p] = np.median(x[:, *p])
    return out


def local_correlation(x: np.ndarray, sigma: np.ndarray, level: float) -> np.ndarray:
    """The mean correlation of each pixel with its eight neighbours, of what rises over its noise; two columns of pixels are
    held at a time."""
    d1, d2 = x.shape[1:]
    total, n = np.zeros((d1, d2)), np.zeros((d1, d2))
    middle = _median(x)
    left = None
    for j in range(d2):
        z = np.where(x[:, :, j] - middle[:, j] > level * sigma[:, j], x[:, :, j], 0.0)
        z -= z.mean(axis=0)
        size = np.sqrt(np.einsum("ty,ty->y", z, z))
        z /= np.where(size > 0, size, np.inf)
        for other, dy in ((z, 1), *([(left, -1), (left, 0), (left, 1)] if j else [])):
            i = j if other is z else j - 1
            ys = slice(max(0, -dy), d1 - max(0, dy))  # of the other; dy lower in z
            to = slice(max(0, dy), d1 - max(0, -dy))
            c = np.einsum("ty,ty->y", other[:, ys], z[:, to])
            total[ys, i] += c
            total[to, j] += c
            n[ys, i] += 1
            n[to, j] += 1
        left = z
    return total / np.maximum(n, 1)


def extracted(raw: np.ndarray, filtered: np.ndarray, centre: tuple[int, int], s: Seeding) -> tuple[np.ndarray, np.ndarray] | None:
    """A component's image and trace in a part of the movie, from its seed: pixels whose filtered traces go with the seed's
    give its trace, those that don't the background's, and both are fitted to every pixel."""
    x = filtered - filtered.mean(axis=0)
    size = np.sqrt(np.einsum("tyx,tyx->yx", x, x))
    x /= np.where(size > 0, size, np.inf)
    alike = np.einsum("t,tyx->yx", x[:, centre[0], centre[1]], x)
    own, outside = alike > s.own, alike < s.outside
    if not own.any():
        return None
    trace = x[:, own].mean(axis=1)
    del x
    rest = np.zeros(len(raw))
    for i in range(0, len(raw) if outside.any() else 0, _STEPS):
        rest[i : i + _STEPS] = np.median(raw[i : i + _STEPS, outside], axis=1)
    design = np.column_stack([trace, rest, np.ones(len(raw))])
    a = np.column_stack([np.maximum(np.linalg.lstsq(design, raw[:, :, j], rcond=None)[0][0], 0) for j in range(raw.shape[2])])
    if not a.any():
        return None
    a = connected(falling(a), reach=1)
    if (a > 0).sum() < s.least_pixels:
        return None
    return a, trace - np.median(trace)


def _less(x: np.ndarray, box: tuple[slice, slice], trace: np.ndarray, image: np.ndarray) -> None:
    """Takes trace times image off x in a box, one pixel after the other."""
    part = x[:, *box]
    for p in zip(*np.nonzero(image)):
        part[:, *p] -= trace * image[p]


def seeded(movie: np.ndarray, s: Seeding, core: tuple[slice, slice] | None = None, own: bool = False) -> list[tuple[tuple[int, int], float, np.ndarray, np.ndarray]]:
    """(seed, score, image, trace) of the components of a movie (t, d1, d2), the best seed first.

    The score is correlation times peak to noise. What is found is taken off the movie and off the filtered one, and both
    images are made anew where that reaches. Components of seeds up to a diameter outside `core` are taken off too, but not
    returned; farther seeds aren't looked at, as the movie may end where they lie. With `own` the movie, an array of doubles,
    is written over. Besides it and the filtered one, a part around one seed is held, and single pixels' traces.
    """
    raw = movie if own else np.array(movie, dtype=float)
    if len(raw) < 4:
        return []
    filtered = high_pass(raw, s)
    sigma = noise(filtered)
    pnr, corr = peak_to_noise(filtered, sigma), local_correlation(filtered, sigma, s.level)
    d1, d2 = raw.shape[1:]
    tried = np.zeros((d1, d2), dtype=bool)
    if core is not None:
        tried[:] = True
        tried[tuple(slice(max(0, c.start - s.diameter), c.stop + s.diameter) for c in core)] = False
    out = []
    half = s.diameter // 2 + 1
    while s.most is None or len(out) < s.most:
        score = np.where((corr >= s.min_corr) & (pnr >= s.min_pnr) & ~tried, corr * pnr, 0.0)
        y, x = np.unravel_index(score.argmax(), score.shape)
        if score[y, x] <= 0:
            break
        tried[y, x] = True
        box = (slice(max(0, y - half), min(d1, y + half + 1)), slice(max(0, x - half), min(d2, x + half + 1)))
        found = extracted(raw[:, *box], filtered[:, *box], (y - box[0].start, x - box[1].start), s)
        if found is None:
            continue
        image, trace = np.zeros((d1, d2)), found[1]
        image[box] = found[0]
        if core is None or (core[0].start <= y < core[0].stop and core[1].start <= x < core[1].stop):
            out.append(((int(y), int(x)), float(score[y, x]), image, trace))
        _less(raw, box, trace, image[box])
        wide = tuple(slice(max(0, b.start - s.reach), min(n, b.stop + s.reach)) for b, n in zip(box, (d1, d2)))
        _less(filtered, wide, trace, high_pass(image, s)[wide])
        more = tuple(slice(max(0, b.start - 1), min(n, b.stop + 1)) for b, n in zip(wide, (d1, d2)))
        inner = tuple(slice(b.start - m.start, b.stop - m.start) for b, m in zip(wide, more))
        pnr[wide] = peak_to_noise(filtered[:, *wide], sigma[wide])
        corr[wide] = local_correlation(filtered[:, *more], sigma[more], s.level)[inner]
    return out
