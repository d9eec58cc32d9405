"""Sequential numeric kernels on one trace, tile or component, for use inside grouped pandas operators."""

from __future__ import annotations

import math

import numpy as np


def half_sample_mode(x: np.ndarray) -> float:
    """The mode of a sample by halving: again and again the shortest half of the sorted values."""
    x = np.sort(np.asarray(x, dtype=float))
    while len(x) > 3:
        n = (len(x) + 1) // 2
        width = x[n - 1 :] - x[: len(x) - n + 1]
        i = int(width.argmin())
        x = x[i : i + n]
    if len(x) == 3:
        a, b = x[1] - x[0], x[2] - x[1]
        return float((x[0] + x[1]) / 2 if a < b else (x[1] + x[2]) / 2 if b < a else x[1])
    return float(x.mean()) if len(x) else math.nan


def log_normal_tail(z: np.ndarray) -> np.ndarray:
    """log of the normal distribution's upper tail, also far out."""
    z = np.asarray(z, dtype=float)
    near = np.array([math.log(max(math.erfc(v / math.sqrt(2)) / 2, 1e-300)) for v in np.ravel(z)]).reshape(z.shape)
    far = np.maximum(z, 8.0)
    return np.where(z > 8, -far * far / 2 - np.log(far * math.sqrt(2 * math.pi)) + np.log1p(-1 / far**2 + 3 / far**4), near)


def event_fitness(x: np.ndarray, steps: int) -> float:
    """The least sum over `steps` steps of the log tail probabilities of values around the mode, a third of their z."""
    mode = half_sample_mode(x)
    low = x[x < mode] - mode
    sd = math.sqrt(float((low * low).sum()) / max(1, len(low))) or 1.0
    tail = log_normal_tail((x - mode) / (3 * sd))
    sums = np.convolve(tail, np.ones(steps))[: len(x)]
    return float(sums.min())


def noise_fft(x: np.ndarray, low: float = 0.25, high: float = 0.5) -> float:
    """The noise level from the mean power in a band of frequencies."""
    n = len(x)
    power = np.abs(np.fft.rfft(x)) ** 2 / n
    band = np.arange(len(power)) / n
    use = (band > low) & (band <= high)
    return float(math.sqrt(power[use].mean())) if use.any() else 0.0


def ar_coefficients(x: np.ndarray, order: int, lags: int = 5, noise: float = 0.0) -> np.ndarray:
    """Autoregressive coefficients from autocovariances by least squares, the noise taken off lag zero."""
    x = np.asarray(x, dtype=float) - np.mean(x)
    lags += order
    c = np.array([float(x[: len(x) - i] @ x[i:]) / len(x) for i in range(lags + 1)])
    c[0] -= noise * noise
    rows = np.array([[c[abs(i - j)] for j in range(1, order + 1)] for i in range(1, lags + 1)])
    return np.linalg.lstsq(rows, c[1:], rcond=None)[0]


def oasis_ar1(y: np.ndarray, g: float, penalty: float = 0.0, least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Deconvolution of an AR(1) trace with non-negative spikes: pools of steps are merged until each rises over the last.

    Returns the denoised trace and the spikes; a spike is 0 or at least `least`.
    """
    n = len(y)
    shrunk = np.asarray(y, dtype=float) - penalty * (1 - g)
    if n:
        shrunk[-1] = y[-1] - penalty
    pools: list[list[float]] = []  # value, weight, start, length
    for t in range(n):
        pools.append([shrunk[t], 1.0, t, 1])
        while len(pools) > 1 and pools[-1][0] < g ** pools[-2][3] * pools[-2][0] + least:
            v, w, _, l = pools.pop()
            last = pools[-1]
            f = g ** last[3]
            last[0] = (last[1] * last[0] + f * w * v) / (last[1] + f * f * w)
            last[1] += f * f * w
            last[3] += l
    c = np.zeros(n)
    for v, _, t, l in pools:
        c[t : t + l] = max(v, 0.0) * g ** np.arange(l)
    s = np.r_[0.0, np.maximum(c[1:] - g * c[:-1], 0.0)] if n else np.zeros(0)
    return c, s


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares by active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    w = a.T @ (b - a @ x)
    for _ in range(rounds):
        if passive.all() or w[~passive].max(initial=-np.inf) <= 1e-10:
            break
        passive[np.flatnonzero(~passive)[w[~passive].argmax()]] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min(initial=1.0) > 0:
                break
            bad = passive & (z <= 0)
            step = (x[bad] / (x[bad] - z[bad])).min()
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = z
        w = a.T @ (b - a @ x)
    return x


def hals(y: np.ndarray, a: np.ndarray, c: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factorisation of pixels by steps, updating one component at a time; a keeps its support."""
    support = a > 0
    for _ in range(rounds):
        ya, aa = a.T @ y, a.T @ a
        for k in range(a.shape[1]):
            c[k] = np.maximum(c[k] + (ya[k] - aa[k] @ c) / max(aa[k, k], 1e-12), 0)
        yc, cc = y @ c.T, c @ c.T
        for k in range(a.shape[1]):
            a[:, k] = np.maximum(a[:, k] + (yc[:, k] - a @ cc[:, k]) / max(cc[k, k], 1e-12), 0) * support[:, k]
    return a, c


def greedy_components(y: np.ndarray, d1: int, d2: int, n: int, reach: int, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Up to n components peeled off a tile: the pixel of most energy, a rank-one fit around it, taken off, again."""
    return peeled(less_median(np.array(y, dtype=float)), d1, d2, n, reach, rounds)


def less_median(y: np.ndarray) -> np.ndarray:
    """y itself, each row less its median."""
    for row in y:
        row -= np.median(row)
    return y


def peeled(left: np.ndarray, d1: int, d2: int, n: int, reach: int, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The components of greedy_components, taken off `left` itself, a pixel's row at a time."""
    a, c = np.zeros((d1 * d2, n)), np.zeros((n, left.shape[1]))
    for k in range(n):
        p = int(np.argmax([(row**2).sum() for row in left]))
        yy, xx = np.arange(d1 * d2) % d1, np.arange(d1 * d2) // d1
        near = (abs(yy - p % d1) <= reach) & (abs(xx - p // d1) <= reach)
        part, trace = left[near], np.maximum(left[p], 0)
        for _ in range(rounds):
            shape = np.maximum(part @ trace, 0)
            shape /= np.linalg.norm(shape) or 1.0
            trace = np.maximum(shape @ part, 0)
        del part
        a[near, k], c[k] = shape, trace
        for q in np.flatnonzero(a[:, k]):
            left[q] -= a[q, k] * trace
    return a, c


def register(frame: np.ndarray, template: np.ndarray, most: int) -> tuple[float, float]:
    """The shift (dy, dx) that moves `frame` onto `template`, to parts of a pixel: the peak of their cross-correlation."""
    f, t = np.fft.fft2(frame - frame.mean()), np.fft.fft2(template - template.mean())
    r = np.fft.ifft2(np.conj(f) * t).real
    d1, d2 = frame.shape
    dy, dx = np.fft.fftfreq(d1, 1 / d1), np.fft.fftfreq(d2, 1 / d2)
    allowed = (abs(dy)[:, None] <= most) & (abs(dx)[None, :] <= most)
    i, j = np.unravel_index(np.where(allowed, r, -np.inf).argmax(), r.shape)

    def part(a: float, b: float, c: float) -> float:
        bend = a - 2 * b + c
        return 0.0 if bend >= 0 else 0.5 * (a - c) / bend

    return dy[i] + part(r[i - 1, j], r[i, j], r[(i + 1) % d1, j]), dx[j] + part(r[i, j - 1], r[i, j], r[i, (j + 1) % d2])


def spike_times(x: np.ndarray, width: int = 3, z: float = 3.5, rounds: int = 3) -> np.ndarray:
    """Times of spikes: a template is averaged from threshold crossings, and its matched filter crossed again."""
    x = (x - np.median(x)) / (1.4826 * np.median(abs(x - np.median(x))) or 1.0)

    def crossings(v: np.ndarray, level: float) -> np.ndarray:
        inner = (v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:]) & (v[1:-1] > level)
        return np.flatnonzero(inner) + 1

    found = crossings(x, z)
    for _ in range(rounds):
        use = found[(found >= width) & (found < len(x) - width)]
        if not len(use):
            break
        shape = np.mean([x[t - width : t + width + 1] for t in use], axis=0)
        v = np.correlate(x, shape - shape.mean(), mode="same")
        found = crossings(v / (1.4826 * np.median(abs(v)) or 1.0), z)
    return found


def impulse(g: np.ndarray, n: int) -> np.ndarray:
    """What an autoregressive trace makes of one spike, over n steps."""
    h = np.zeros(n)
    for t in range(n):
        h[t] = 1.0 if t == 0 else sum(a * h[t - i] for i, a in enumerate(g, 1) if t >= i)
        if t > 10 and abs(h[t]) < 1e-9 and abs(h[t - 1]) < 1e-9:
            break
    return h


def sparse_spikes(y: np.ndarray, g: np.ndarray, penalty: float = 0.0, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(trace, spikes) of least |y - trace|^2 / 2 + penalty * spikes with spikes >= 0, for an autoregressive trace of any
    order: accelerated projected gradients, each by two transforms."""
    n = len(y)
    if not n:
        return np.zeros(0), np.zeros(0)
    size = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(impulse(g, n), size)
    run = lambda s: np.fft.irfft(np.fft.rfft(s, size) * spectrum, size)[:n]
    back = lambda r: np.fft.irfft(np.fft.rfft(r, size) * np.conj(spectrum), size)[:n]
    step, s, z, k = 1.0 / float((abs(spectrum) ** 2).max()), np.zeros(n), np.zeros(n), 1.0
    for _ in range(rounds):
        new = np.maximum(z - step * (back(run(z) - y) + penalty), 0.0)
        if ((z - new) @ (new - s)) > 0:
            k = 1.0  # the momentum points uphill: it starts anew
        nk = (1 + math.sqrt(1 + 4 * k * k)) / 2
        z, change = new + (k - 1) / nk * (new - s), abs(new - s).max()
        s, k = new, nk
        if change < 1e-9 * max(1.0, s.max()):
            break
    return run(s), s


def constrained_spikes(y: np.ndarray, g: np.ndarray, noise: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, float]:
    """(trace, spikes, penalty): the sparsest spikes whose trace leaves residuals of size `noise`, by bisection of the penalty."""
    solve = (lambda p: oasis_ar1(y, float(g[0]), p)) if len(g) == 1 else (lambda p: sparse_spikes(y, g, p))
    left = lambda c: float(((y - c) ** 2).mean())
    c, s = solve(0.0)
    if left(c) >= noise * noise:
        return c, s, 0.0
    low, high = 0.0, max(1e-6, float(abs(y).max()))
    while left(solve(high)[0]) < noise * noise and high < 1e12:
        high *= 4
        if not solve(high)[0].any():
            break
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if left(solve(mid)[0]) < noise * noise else (low, mid)
    c, s = solve(low)
    return c, s, low


def stable_ar(x: np.ndarray, order: int, noise: float) -> np.ndarray:
    """Estimated coefficients whose roots are real, positive and below one, as decays are."""
    g = ar_coefficients(x, order, noise=noise)
    roots = np.clip(np.sort(np.roots([1.0, *-g]).real), 0.02, 0.98)
    return -np.poly(roots)[1:]


def nnls_gram(gram: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Non-negative least squares from the products alone: x >= 0 of least x' gram x / 2 - b' x, by active sets."""
    n = len(b)
    x, passive, w, tol = np.zeros(n), np.zeros(n, dtype=bool), b.astype(float).copy(), 1e-10 * max(1.0, float(abs(b).max(initial=0.0)))
    for _ in range(rounds or 3 * n):
        if passive.all() or w[~passive].max(initial=-np.inf) <= tol:
            break
        passive[np.flatnonzero(~passive)[w[~passive].argmax()]] = True
        while passive.any():
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(gram[np.ix_(passive, passive)], b[passive], rcond=None)[0]
            if z[passive].min() > 0:
                break
            bad = passive & (z <= 0)
            x = x + (x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min() * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        else:
            z = np.zeros(n)
        x = z
        w = b - gram @ x
    return x


def nnls_wide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Non-negative least squares of few rows and many columns, by active sets: what is solved at once are the columns in
    use, of which there are no more than rows, and the product of a with itself is never made."""
    n = a.shape[1]
    x, own, rest = np.zeros(n), np.zeros(0, dtype=int), b.astype(float)
    w = a.T @ rest
    tol, left = 1e-10 * max(1.0, float(abs(w).max(initial=0.0))), float(rest @ rest)
    while n:
        w[own] = -np.inf
        new = int(w.argmax())
        if w[new] <= tol:
            break
        before, own = (x[own].copy(), own), np.r_[own, new]
        while len(own):
            z = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if z.min() > 0:
                break
            bad = z <= 0
            held = x[own]
            held = held + (held[bad] / np.maximum(held[bad] - z[bad], 1e-300)).min() * (z - held)
            x[own] = 0
            own, held = own[held > 1e-12], held[held > 1e-12]
            x[own] = held
        x[own] = z if len(own) else 0.0
        rest = b - a[:, own] @ x[own]
        if float(rest @ rest) >= left:  # nothing but rounding is left
            x[own] = 0
            x[before[1]] = before[0]
            break
        left, w = float(rest @ rest), a.T @ rest
    return x
