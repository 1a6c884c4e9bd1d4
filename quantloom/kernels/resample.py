"""Index paths of bootstrap resamplers, drawn from one sequential stream: the exact mode of the operators."""

from __future__ import annotations

import math

import numpy as np

from .rng import Gaussian, Source


def circular(source: Source, n: int, block: int) -> np.ndarray:
    """Blocks that start anywhere and wrap round; the last is cut. block 1 is the IID bootstrap."""
    if block < 1:
        raise ValueError("the block must have at least one element")
    starts = source.ints(-(-n // block), n)
    at = np.arange(n)
    return (starts[at // block] + at % block) % n


def moving(source: Source, n: int, block: int) -> np.ndarray:
    """Blocks that lie within the series."""
    if not 1 <= block <= n:
        raise ValueError("the block must fit the series")
    starts = source.ints(-(-n // block), n - block + 1)
    at = np.arange(n)
    return starts[at // block] + at % block


def stationary(source: Source, n: int, mean_block: float) -> np.ndarray:
    """Runs of geometric length: after each element a new run begins with probability 1 / mean_block."""
    if not mean_block >= 1:
        raise ValueError("the mean block length must be at least 1")
    out = np.empty(n, np.int64)
    at = source.next_int(n)
    for k in range(n):
        out[k] = at
        at = source.next_int(n) if source.next_double() < 1 / mean_block else (at + 1) % n
    return out


def wild_weights(source: Source, n: int, kind: str = "mammen") -> np.ndarray:
    """Independent weights: mammen (two points), rademacher (signs) or gaussian."""
    if kind == "gaussian":
        return Gaussian(source).batch(n)
    u = np.array([source.next_double() for _ in range(n)])
    if kind == "rademacher":
        return np.where(u < 0.5, -1.0, 1.0)
    if kind != "mammen":
        raise ValueError(f"unknown weights {kind}")
    root = math.sqrt(5)
    return np.where(u < (root + 1) / (2 * root), -(root - 1) / 2, (root + 1) / 2)


def politis_white(x) -> float:
    """Block length for the stationary bootstrap; depends on the scale of the data, as its variance term does."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 32:
        raise ValueError("at least 32 observations are needed")
    z = x - x.mean()
    var = z @ z / n
    if var <= 0:
        return 1.0
    most = min(max(5, math.ceil(5 * math.log10(n))), n // 2)
    rho = np.array([z[k:] @ z[: n - k] / n for k in range(most + 1)]) / var
    limit, run = 2 * math.sqrt(math.log10(n) / n), max(5, math.ceil(math.log10(n)))
    quiet = [k for k in range(1, most - run + 1) if (np.abs(rho[k + 1 : k + run + 1]) < limit).all()]
    m = min(2 * (quiet[0] if quiet else max(most - run, 1)), most)
    lags = np.arange(1, m + 1)
    flat = np.clip(2 * (1 - lags / m), 0, 1)
    g = 2 * (flat * lags * np.abs(rho[1 : m + 1])).sum()
    d = var * (1 + 2 * (flat * rho[1 : m + 1]).sum())
    if d * d <= 1e-18:
        return 1.0
    return float(min(max((2 * g * g / (d * d) * n) ** (1 / 3), 1.0), n / 2))
