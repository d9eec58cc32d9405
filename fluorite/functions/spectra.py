"""Power spectra of one trace, and what they say of its noise."""

from __future__ import annotations

import numpy as np


def welch(x: np.ndarray, width: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power densities: the mean over half-overlapping Hann windows of the trace less their mean."""
    width = min(width, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)
    starts = range(0, len(x) - width + 1, max(1, width - width // 2))
    parts = np.stack([x[i : i + width] for i in starts])
    power = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window)) ** 2).mean(axis=0) / (window**2).sum()
    power[1 : len(power) - (1 - width % 2)] *= 2
    return np.arange(len(power)) / width, power


def level(power: np.ndarray, method: str) -> float:
    """The noise that one-sided densities tell, by their mean, their median or the mean of their logarithms."""
    if method == "mean":
        return float(np.sqrt(power.mean() / 2))
    if method == "median":
        return float(np.sqrt(np.median(power) / 2))
    return float(np.sqrt(np.exp(np.log(np.maximum(power / 2, 1e-300)).mean())))
