"""Smoothing kernels as plain lists of weights."""

from __future__ import annotations

import math


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights out to ``truncate`` deviations."""
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def hanning(n: int) -> list[float]:
    """Normalised Hanning weights; equal ones for two points or fewer."""
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)] if n > 2 else [1.0] * n
    return [x / sum(w) for x in w]


def savitzky_golay(window: int, order: int) -> list[float]:
    """Weights that evaluate, at the centre, the least-squares polynomial of a window."""
    import numpy as np

    half = window // 2
    at = np.arange(-half, window - half)
    return np.linalg.pinv(np.vander(at, min(order, window - 1) + 1, increasing=True))[0].tolist()
