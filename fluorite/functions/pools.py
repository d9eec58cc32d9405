"""Incremental deconvolution of an autoregressive trace of order one: a stack of pools that grows and is popped."""

from __future__ import annotations

import numpy as np


class Pools:
    """Pools of steps, each decaying from one value, of a trace that arrives in pieces.

    A pool is (sum, weight, start, length); its first value is sum / weight. What pools say after any pieces is what
    kernels.oasis_ar1() says of the whole, but for its penalty on the last step, which finish() gives.
    """

    def __init__(self, g: float, penalty: float = 0.0, least: float = 0.0, stack: np.ndarray | None = None):
        self.g, self.penalty, self.least = g, penalty, least
        self.stack: list[list[float]] = [] if stack is None else [[v, w, int(t), int(n)] for v, w, t, n in np.asarray(stack, dtype=float).reshape(-1, 4)]

    @property
    def end(self) -> int:
        """The next step."""
        return self.stack[-1][2] + self.stack[-1][3] if self.stack else 0

    def array(self) -> np.ndarray:
        return np.array(self.stack, dtype=float).reshape(-1, 4)

    def _settle(self) -> None:
        """Merges the last pools until each rises over what its predecessor has decayed to."""
        pools, g = self.stack, self.g
        while len(pools) > 1:
            (v, w, _, n), (u, x, t, m) = pools[-1], pools[-2]
            if v / w >= g**m * u / x + self.least:
                break
            pools.pop()
            f = g**m
            pools[-1] = [u + f * v, x + f * f * w, t, m + n]

    def extend(self, y: np.ndarray) -> int:
        """Takes the next steps; returns the first step whose value may have changed."""
        first = self.end
        for v in np.asarray(y, dtype=float).tolist():
            self.stack.append([v - self.penalty * (1 - self.g), 1.0, self.end, 1])
            self._settle()
            first = min(first, self.stack[-1][2])
        return first

    def peek(self, y: float) -> float:
        """The value that a next step of y would get, without taking it."""
        v, w, n = y - self.penalty * (1 - self.g), 1.0, 1
        for u, x, _, m in reversed(self.stack):
            f = self.g**m
            if v / w >= f * u / x + self.least:
                break
            v, w, n = u + f * v, x + f * f * w, n + m
        return max(v / w, 0.0) * self.g ** (n - 1)

    def pop(self) -> int:
        """Drops the last pool; returns the step to go on from."""
        return int(self.stack.pop()[2])

    def finish(self) -> None:
        """Gives the last step the whole penalty, as no spike follows it."""
        if self.stack:
            v, w, t, n = self.stack[-1]
            self.stack[-1] = [v - self.penalty * self.g * self.g ** (n - 1), w, t, n]
            self._settle()

    def settled(self, before: int) -> np.ndarray:
        """Takes out and returns the pools that end at `before` or earlier; later steps can't reach them any more."""
        n = 0
        while n < len(self.stack) - 1 and self.stack[n][2] + self.stack[n][3] <= before:
            n += 1
        out = np.array(self.stack[:n], dtype=float).reshape(-1, 4)
        if n:
            self.stack = self.stack[n:]
        return out

    def trace(self, first: int = 0) -> np.ndarray:
        """The denoised trace from step `first` on."""
        n = len(self.stack)
        while n and self.stack[n - 1][2] + self.stack[n - 1][3] > first:
            n -= 1
        return unrolled(np.array(self.stack[n:], dtype=float).reshape(-1, 4), self.g, first)

    def tail(self, n: int) -> list[float]:
        """The denoised last n steps: trace() from there on, pool by pool, as a step mostly changes few."""
        out, left = [], n
        for v, w, _, length in reversed(self.stack):
            if left <= 0:
                break
            some = min(left, length)
            level = max(v / w, 0.0)
            out.append([level * f for f in _powers(self.g, length)[length - some : length]])
            left -= some
        return [v for part in reversed(out) for v in part]

    def value(self) -> float:
        """The denoised last step."""
        v, w, _, n = self.stack[-1]
        return max(v / w, 0.0) * self.g ** (n - 1)


_POWERS: dict[float, list[float]] = {}


def _powers(g: float, n: int) -> list[float]:
    """g ** 0, g ** 1, ..., n of them at least."""
    if len(_POWERS.get(g, ())) < n:
        _POWERS[g] = (g ** np.arange(max(64, 2 * n))).tolist()
    return _POWERS[g]


def unrolled(pools: np.ndarray, g: float, first: int = 0) -> np.ndarray:
    """Values from step `first` on of pools in order (the last one that starts at or before it, and all after)."""
    pools = pools[pools[:, 2] + pools[:, 3] > first]
    if not len(pools):
        return np.zeros(0)
    n = pools[:, 3].astype(int)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    c = np.repeat(np.maximum(pools[:, 0] / pools[:, 1], 0.0), n) * g**inside
    return c[max(0, first - int(pools[0, 2])) :]


def spikes(c: np.ndarray, g: float) -> np.ndarray:
    return np.r_[0.0, np.maximum(c[1:] - g * c[:-1], 0.0)] if len(c) else np.zeros(0)
