"""Demixing frame by frame: what one field of view has to remember between frames, and how a frame changes it."""

from __future__ import annotations

import io
import json
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np

from .pools import Pools


@dataclass(frozen=True)
class Settings:
    """d1 by d2 pixels, p = y + x * d1; components reach `radius` pixels from their centre.

    The first `start` frames give the background. The last `buffer` frames are kept: what they leave unexplained is where
    components are born. g is the decay of a component's trace for a step, None for no deconvolution.
    """

    d1: int
    d2: int
    radius: int = 3
    start: int = 100
    buffer: int = 100
    g: float | None = 0.9
    rounds: int = 3
    update_every: int = 25
    births: bool = True
    trials: int = 3
    space_corr: float = 0.8
    least_snr: float = 4.0
    overlap: float = 0.6
    alike: float = 0.25
    event: int = 3

    def __post_init__(self):
        if self.buffer < self.start or self.start < 2:
            raise ValueError("the buffer must hold the frames of the start, two at least")


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    size = float(np.sqrt((a @ a) * (b @ b)))
    return float(a @ b) / size if size > 1e-12 else 0.0


@lru_cache
def _smoother(d: int, radius: int) -> np.ndarray:
    """A Gaussian of half the radius less the mean of a wider box, along one side, rows summing to nothing."""
    away = abs(np.subtract.outer(np.arange(d), np.arange(d)))
    near = np.exp(-((away / max(0.5, radius / 2)) ** 2) / 2) * (away <= 2 * radius)
    return near / near.sum(axis=1, keepdims=True)


class Field:
    """One field: footprints ab (pixel, component; the first is the background), their support, and traces c of the last
    frames; running means of traces by pixels (cy) and of traces by traces (cc); frames, residuals and residual energy of
    the buffer; a stack of pools for each component."""

    def __init__(self, settings: Settings):
        self.settings, self.pixels = settings, settings.d1 * settings.d2
        self.n, self.last, self.pools = 0, None, []
        empty = lambda *shape: np.zeros(shape)
        self.times, self.raw, self.left, self.energy = np.zeros(0, dtype=np.int64), empty(0, self.pixels), empty(0, self.pixels), empty(0, self.pixels)
        self.ab, self.support, self.c = empty(self.pixels, 0), np.zeros((self.pixels, 0), dtype=bool), empty(0, 0)
        self.cy, self.cc = empty(0, self.pixels), empty(0, 0)
        self.drawn: list[tuple[int, int, np.ndarray]] = []
        self._gram: np.ndarray | None = None  # of ab with itself, until footprints change

    _ARRAYS = ("times", "raw", "left", "energy", "ab", "support", "c", "cy", "cc")

    def dumps(self) -> bytes:
        out = io.BytesIO()
        about = json.dumps({"settings": asdict(self.settings), "n": self.n, "last": self.last})
        stacks = {f"pools{i}": p.array() for i, p in enumerate(self.pools)}
        np.savez(out, about=np.frombuffer(about.encode(), dtype=np.uint8), **{a: getattr(self, a) for a in self._ARRAYS}, **stacks)
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Field:
        with np.load(io.BytesIO(raw)) as held:
            about = json.loads(held["about"].tobytes())
            field = cls(Settings(**about["settings"]))
            field.n, field.last = about["n"], about["last"]
            for a in cls._ARRAYS:
                setattr(field, a, held[a])
            field.pools = [Pools(field.settings.g, stack=held[f"pools{i}"]) for i in range(field.k)] if field.settings.g is not None else []
        return field

    @property
    def k(self) -> int:
        """Components without the background."""
        return max(0, self.ab.shape[1] - 1)

    def footprints(self) -> np.ndarray:
        return self.ab[:, 1:]

    def step(self, t: int, frame: np.ndarray | None) -> list[tuple[int, int, float]]:
        """Takes the frame of step t; returns (t, component, value). A component that is born has values for the whole
        buffer. `drawn` then holds (t, component, footprint) of those that are new or were updated.

        A frame that is null, of another size, or has a missing pixel is left out.
        """
        if self.last is not None and t <= self.last:
            raise ValueError(f"frame {t} doesn't come after frame {self.last}")
        self.last, self.drawn = t, []
        y = np.asarray(frame if frame is not None else [], dtype=float)
        if y.shape != (self.pixels,) or not np.isfinite(y).all():
            return []
        s = self.settings
        self.n += 1
        self.times = np.r_[self.times, t][-s.buffer :]
        self.raw = np.vstack([self.raw, y])[-s.buffer :]
        if self.n < s.start:
            return []
        if self.n == s.start:
            self._begin()
            out: list[tuple[int, int, float]] = []
        else:
            self._follow(y)
            out = [(t, k, float(self.c[k + 1, -1])) for k in range(self.k)]
        if s.births:
            while self._birth():
                k = self.k - 1
                out += [(int(u), k, float(v)) for u, v in zip(self.times, self.c[-1])]
                self.drawn.append((t, k, self.ab[:, -1].copy()))
                if self.n > s.start:
                    break  # one for each frame
        if self.n % s.update_every == 0:
            self._reshape()
            self.drawn += [(t, k, self.ab[:, k + 1].copy()) for k in range(self.k)]
        return out

    def _filtered(self, frames: np.ndarray) -> np.ndarray:
        """Energy of frames' local rises."""
        s = self.settings
        images = frames.reshape(-1, s.d2, s.d1)
        near = _smoother(s.d2, s.radius) @ images @ _smoother(s.d1, s.radius).T
        wide = _smoother(s.d2, 3 * s.radius) @ images @ _smoother(s.d1, 3 * s.radius).T
        return np.maximum(near - wide, 0.0).reshape(len(frames), -1) ** 2

    def _begin(self) -> None:
        b = np.maximum(np.median(self.raw, axis=0), 0.0)
        b = b / (np.linalg.norm(b) or 1.0)
        self.ab, self.support, self._gram = b[:, None], np.ones((self.pixels, 1), dtype=bool), None
        self.c = (self.raw @ b)[None]
        self.cy, self.cc = self.c @ self.raw / self.n, self.c @ self.c.T / self.n
        self.left = self.raw - self.c.T @ self.ab.T
        self.energy = self._filtered(self.left)

    def _follow(self, y: np.ndarray) -> None:
        """The frame's values by coordinate descent, components through their pools, and what they add to the sums."""
        s, ab = self.settings, self.ab
        if self._gram is None:
            self._gram = ab.T @ ab
        seen, rows, size = (ab.T @ y).tolist(), list(self._gram), self._gram.diagonal().tolist()
        c = self.c[:, -1].copy()
        if s.g is not None:
            c[1:] *= s.g
        first = self.c.shape[1]
        self.c = np.hstack([self.c, c[:, None]])
        for turn in range(s.rounds):
            for m in range(len(c)):
                free = float(c[m]) + (seen[m] - float(rows[m].dot(c))) / size[m] if size[m] > 1e-12 else 0.0
                if m == 0 or s.g is None:
                    c[m] = max(free, 0.0)
                elif turn < s.rounds - 1:
                    c[m] = self.pools[m - 1].peek(free)
                else:
                    pool = self.pools[m - 1]
                    changed = pool.extend([free])
                    n = min(pool.end - changed, first + 1)
                    told = pool.tail(n)
                    self.c[m, -n:] = told
                    pool.settled(pool.end - 2 * s.buffer)  # older ones are told already
                    c[m] = told[-1]
        self.c[:, -1] = c
        self.c = self.c[:, -s.buffer :]
        rest = y - ab @ c
        self.left = np.vstack([self.left, rest])[-s.buffer :]
        self.energy = np.vstack([self.energy, self._filtered(rest[None])])[-s.buffer :]
        self.cy += (np.outer(c, y) - self.cy) / self.n
        self.cc += (np.outer(c, c) - self.cc) / self.n

    def _birth(self) -> bool:
        """Adds the component that best explains the residuals around one of their strongest places, if one passes."""
        s = self.settings
        energy = self.energy.sum(axis=0)
        yy, xx = np.arange(self.pixels) % s.d1, np.arange(self.pixels) // s.d1
        for _ in range(s.trials):
            p = int(energy.argmax())
            if energy[p] <= 0:
                return False
            near = (abs(yy - yy[p]) <= s.radius) & (abs(xx - xx[p]) <= s.radius)
            part = self.left[:, near]
            trace = np.maximum(self.left[:, p], 0.0)
            for _ in range(10):
                shape = np.maximum(trace @ part, 0.0)
                shape /= np.linalg.norm(shape) or 1.0
                trace = np.maximum(part @ shape, 0.0)
            if self._passes(near, shape, part, trace):
                self._add(near, shape, part @ shape)
                return True
            energy[near] = 0.0
        return False

    def _passes(self, near: np.ndarray, shape: np.ndarray, part: np.ndarray, trace: np.ndarray) -> bool:
        s = self.settings
        if not trace.any() or _correlation(shape, part.mean(axis=0)) <= s.space_corr:
            return False
        seen = part @ shape
        noise = 1.4826 * float(np.median(abs(np.diff(seen)))) / np.sqrt(2)
        level = np.convolve(seen - np.median(seen), np.ones(s.event) / np.sqrt(s.event), mode="valid")
        if level.max() <= s.least_snr * noise:
            return False
        for m in range(1, self.ab.shape[1]):
            size = float(np.linalg.norm(self.ab[:, m]))
            if size and shape @ self.ab[near, m] / size > s.overlap and _correlation(trace, self.c[m]) > s.alike:
                return False
        return True

    def _add(self, near: np.ndarray, shape: np.ndarray, seen: np.ndarray) -> None:
        s = self.settings
        a = np.zeros(self.pixels)
        a[near] = shape
        if s.g is None:
            c = np.maximum(seen, 0.0)
        else:
            pool = Pools(s.g)
            pool.extend(seen)
            self.pools.append(pool)
            c = pool.trace()
        both = np.vstack([self.c, c]) @ c / self.n
        self.cc = np.block([[self.cc, both[:-1, None]], [both[None, :-1], both[None, -1:]]])
        self.cy = np.vstack([self.cy, c @ self.raw / self.n])
        self.ab, self.support = np.hstack([self.ab, a[:, None]]), np.hstack([self.support, near[:, None]])
        self._gram = None
        self.c = np.vstack([self.c, c])
        self.left = self.left - np.outer(c, a)
        self.energy = self._filtered(self.left)

    def _reshape(self) -> None:
        """Footprints by block-coordinate descent from the running sums, within their support."""
        self._gram = None
        for _ in range(2):
            for m in range(self.ab.shape[1]):
                if self.cc[m, m] <= 1e-12:
                    continue
                a = np.maximum(self.ab[:, m] + (self.cy[m] - self.ab @ self.cc[m]) / self.cc[m, m], 0.0) * self.support[:, m]
                size = float(np.linalg.norm(a))
                if size > 0:
                    self.ab[:, m] = a / max(1.0, size) if m else a
