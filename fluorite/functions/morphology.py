"""Shapes in images and volumes: labels, holes, opening and closing, distances, flooding, peaks, and masks of components."""

from __future__ import annotations

import functools
import heapq
from itertools import product

import numpy as np


def offsets(n: int, diagonal: bool) -> list[tuple[int, ...]]:
    """The half of a pixel's neighbours that comes after it in order."""
    every = [o for o in product((-1, 0, 1), repeat=n) if o > (0,) * n]
    return every if diagonal else [o for o in every if sum(map(abs, o)) == 1]


def _beside(a: np.ndarray, o: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Views of each pixel and of its neighbour at an offset, where both are inside."""
    here = tuple(slice(max(0, -s), a.shape[i] - max(0, s)) for i, s in enumerate(o))
    there = tuple(slice(max(0, s), a.shape[i] - max(0, -s)) for i, s in enumerate(o))
    return a[here], a[there]


def label(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """For each set pixel the smallest place, in column-major order, of those it is connected with; -1 elsewhere."""
    place = np.arange(mask.size).reshape(mask.shape, order="F")
    us, vs = [], []
    for o in offsets(mask.ndim, diagonal):
        a, b = _beside(mask, o)
        p, q = _beside(place, o)
        both = a & b
        us.append(p[both])
        vs.append(q[both])
    root = np.arange(mask.size)
    u, v = np.concatenate(us or [np.zeros(0, int)]), np.concatenate(vs or [np.zeros(0, int)])
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return np.where(mask, root[place], -1)


def sizes(labels: np.ndarray) -> dict[int, int]:
    names, n = np.unique(labels[labels >= 0], return_counts=True)
    return dict(zip(names.tolist(), n.tolist()))


def without_small(mask: np.ndarray, least: int, diagonal: bool = False) -> np.ndarray:
    """The mask without connected parts of fewer than `least` pixels."""
    labels = label(mask, diagonal)
    keep = [k for k, n in sizes(labels).items() if n >= least]
    return mask & np.isin(labels, keep)


def without_holes(mask: np.ndarray, most: int | None = None) -> np.ndarray:
    """The mask with the unset parts filled that don't reach the border, or, given `most`, all of fewer pixels than that."""
    labels = label(~mask)
    if most is None:
        rim = np.ones(mask.shape, dtype=bool)
        rim[tuple(slice(1, -1) for _ in mask.shape)] = False
        keep = np.unique(labels[rim & ~mask])
    else:
        keep = [k for k, n in sizes(labels).items() if n >= most]
    return ~(~mask & np.isin(labels, keep))


def _around(x: np.ndarray, reach: int, what, outside: float) -> np.ndarray:
    for axis in range(x.ndim):
        pad = [(reach, reach) if i == axis else (0, 0) for i in range(x.ndim)]
        x = what(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, constant_values=outside), 2 * reach + 1, axis=axis), axis=-1)
    return x


def dilate(x: np.ndarray, reach: int) -> np.ndarray:
    """The maximum over a square (cube) of 2 * reach + 1 pixels; what is outside doesn't count."""
    return _around(np.asarray(x, dtype=float), reach, np.max, -np.inf)


def erode(x: np.ndarray, reach: int) -> np.ndarray:
    return _around(np.asarray(x, dtype=float), reach, np.min, np.inf)


def opened(x: np.ndarray, reach: int) -> np.ndarray:
    return dilate(erode(x, reach), reach)


def closed(x: np.ndarray, reach: int) -> np.ndarray:
    return erode(dilate(x, reach), reach)


def distance(mask: np.ndarray) -> np.ndarray:
    """The straight distance of each set pixel to the nearest unset one, exactly, axis by axis; infinite if there is none."""
    d = np.where(mask, np.inf, 0.0)
    for axis, n in enumerate(mask.shape):
        apart = np.subtract.outer(np.arange(n), np.arange(n)).astype(float) ** 2
        rows = np.moveaxis(d, axis, -1)
        out = np.full(rows.shape, np.inf)
        for j in range(n):
            out = np.minimum(out, rows[..., j : j + 1] + apart[j])
        d = np.moveaxis(out, -1, axis)
    return np.sqrt(d)


def flooded(height: np.ndarray, markers: np.ndarray, mask: np.ndarray | None = None, diagonal: bool = False) -> np.ndarray:
    """Basins that grow from markers (0: none) over an image, the lowest pixels first and of these the earliest reached;
    pixels outside the mask stay 0."""
    out = np.where(mask, markers, 0) if mask is not None else markers.copy()
    near = [o for o in offsets(height.ndim, diagonal)]
    near += [tuple(-s for s in o) for o in near]
    queue, turn = [], 0
    for p in zip(*np.nonzero(out)):
        queue.append((height[p], turn, p))
        turn += 1
    heapq.heapify(queue)
    while queue:
        _, _, p = heapq.heappop(queue)
        for o in near:
            q = tuple(a + b for a, b in zip(p, o))
            if all(0 <= a < n for a, n in zip(q, height.shape)) and not out[q] and (mask is None or mask[q]):
                out[q] = out[p]
                heapq.heappush(queue, (max(height[q], height[p]), turn, q))
                turn += 1
    return out


def peaks(x: np.ndarray, apart: int = 1, least: float | None = None, share: float | None = None, border: int | None = None, most: int | None = None) -> np.ndarray:
    """Places (row for each, one column for each axis) that hold the maximum of the square of 2 * apart + 1 pixels around
    them, the highest first, ties in row-major order.

    They are over `least` (the image's minimum) and over `share` of its maximum, and `border` (apart) pixels from the edge.
    An image of one value has none; of a flat top all pixels are peaks. Outside the image is 0.
    """
    x = np.asarray(x, dtype=float)
    if not x.size or (x == x.flat[0]).all():
        return np.zeros((0, x.ndim), dtype=int)
    top = x == _around(x, apart, np.max, 0.0)
    border = apart if border is None else border
    if border:
        inside = np.zeros(x.shape, dtype=bool)
        inside[tuple(slice(border, -border) for _ in x.shape)] = True
        top &= inside
    level = x.min() if least is None else least
    top &= x > (level if share is None else max(level, share * x.max()))
    at = np.nonzero(top)
    return np.transpose(at)[np.argsort(-x[at], kind="stable")[:most]]


def boxed(change):
    """Makes a change of an image one of the box of its pixels that aren't 0."""
    @functools.wraps(change)
    def run(x: np.ndarray, *args, **more) -> np.ndarray:
        held = np.nonzero(x)
        if not len(held[0]):
            return x.copy()
        box = tuple(slice(int(i.min()), int(i.max()) + 1) for i in held)
        out = np.zeros_like(x)
        if more.get("at") is not None:
            more["at"] = tuple(np.asarray(a)[b] for a, b in zip(more["at"], box))
        out[box] = change(x[box], *args, **more)
        return out

    return run


@boxed
def falling(x: np.ndarray, at: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
    """A footprint that falls from its peak: pixels under a third of it that rise away from it go, then what isn't
    connected with the peak, but for one pixel around. at tells where rows and columns lie, if some empty ones are left out."""
    if x.size <= 1:
        return x.copy()
    top = np.unravel_index(x.argmax(), x.shape)
    out, rise = x.copy(), np.zeros(x.shape)
    for axis, n in enumerate(x.shape):
        if n > 1:
            place = np.arange(n) if at is None else at[axis]
            toward = (place[top[axis]] - place).reshape([-1 if i == axis else 1 for i in range(x.ndim)])
            rise = rise + np.gradient(x, axis=axis) * toward
    out[(rise < 0) & (x < x[top] / 3)] = 0
    labels = label(out != 0)
    own = labels == labels[top]
    near = own.copy()
    for o in offsets(x.ndim, False):
        for p in (o, tuple(-s for s in o)):
            there, here = _beside(near, p)[1], _beside(own, p)[0]
            there |= here
    return np.where(near, out, 0)


def connected(x: np.ndarray, share: float = 0.01, reach: int = 2) -> np.ndarray:
    """A footprint's part around its peak: opened, over `share` of the peak, and connected with the highest of that."""
    open_ = opened(x, reach)
    if open_.max() <= 0:
        return np.zeros_like(x)
    labels = label(open_ > share * x.max())
    top = np.unravel_index(np.where(labels >= 0, x, -np.inf).argmax(), x.shape)
    return np.where(labels == labels[top], x, 0)


def cleaned(x: np.ndarray, level: float = 0.2, reach: int = 1) -> np.ndarray:
    """A footprint's largest blob: smoothed by medians, cut at a share of its maximum, closed; weights are its own."""
    from numpy.lib.stride_tricks import sliding_window_view

    smooth = np.median(sliding_window_view(np.pad(x, 1, mode="symmetric"), (3,) * x.ndim), axis=tuple(range(x.ndim, 2 * x.ndim)))
    if smooth.max() <= 0:
        return x.copy()
    mask = closed(smooth > level * smooth.max(), reach) > 0
    labels = label(mask)
    count = sizes(labels)
    best = max(count, key=lambda k: (count[k], -k))
    return np.where(labels == best, x, 0)


def masks(image: np.ndarray, radius: int, least: int, hole: int, diagonal: bool = False) -> np.ndarray:
    """Labels (-1: none) of the bright things of an image of structure: brighter than the mean of a square around, whole
    holes under `hole` pixels filled, things under `least` pixels left out, and touching ones cut by flooding from the
    middles of their distances."""
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(image, radius, mode="edge"), (2 * radius + 1,) * image.ndim)
    local = wide.mean(axis=tuple(range(image.ndim, 2 * image.ndim)))
    mask = without_small(without_holes(image > local, hole), least, diagonal)
    deep = distance(mask)
    deep = np.where(np.isfinite(deep), deep, 0.0)
    seeds = label((deep == dilate(deep, max(1, radius // 2))) & mask, True) + 1
    basins = flooded(-deep, seeds, mask, diagonal)
    out = np.full(image.shape, -1)
    place = np.arange(image.size).reshape(image.shape, order="F")
    for k in np.unique(basins[basins > 0]):
        own = basins == k
        if own.sum() >= least:
            out[own] = place[own].min()
    return out
