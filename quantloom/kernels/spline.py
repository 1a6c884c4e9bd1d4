"""Curve coefficients from knots: numpy only."""

from __future__ import annotations

import numpy as np


def check(x, y, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) != len(y) or len(x) < least:
        raise ValueError(f"at least {least} knots with as many values are needed")
    if (np.diff(x) <= 0).any():
        raise ValueError("knots must be strictly increasing")
    return x, y


def second_derivatives(x, y, kind: str = "natural", left: float = 0.0, right: float = 0.0) -> np.ndarray:
    """Second derivatives at the knots of a cubic spline.

    kind: natural, clamped (end slopes left, right), not_a_knot, modified_not_a_knot
    (not-a-knot terms weighted by the ratio of the end spacings) or qspline
    (end rows 11 s + 7 s' = 48 times the midpoint's defect over the spacing squared).
    """
    x, y = check(x, y, 4 if kind in ("not_a_knot", "modified_not_a_knot") else 2)
    n = len(x)
    if n == 2 and kind in ("natural", "qspline"):
        return np.zeros(2)
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    inner = np.arange(1, n - 1)
    a[inner, inner - 1], a[inner, inner], a[inner, inner + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    b[inner] = 6 * np.diff(slope)
    if kind == "natural":
        a[0, 0] = a[-1, -1] = 1.0
    elif kind == "clamped":
        a[0, :2], b[0] = (2 * h[0], h[0]), 6 * (slope[0] - left)
        a[-1, -2:], b[-1] = (h[-1], 2 * h[-1]), 6 * (right - slope[-1])
    elif kind in ("not_a_knot", "modified_not_a_knot"):
        # the end value is w times the line through its two neighbours
        for end, (i, j, k), (p, q) in ((0, (0, 1, 2), (h[0], h[1])), (-1, (n - 1, n - 2, n - 3), (h[-1], h[-2]))):
            w = 1.0 if kind == "not_a_knot" else min(p, q) / max(p, q)
            a[end] = 0.0
            a[end, i], a[end, j], a[end, k] = 1.0, -w * (p + q) / q, w * p / q
    elif kind == "qspline":
        for end, i in ((0, 0), (-1, n - 2)):
            first = min(i, n - 3)
            at = slice(first, first + 3)
            mid = np.polyval(np.polyfit(x[at] - x[i], y[at], 2), h[i] / 2)
            b[end] = 48 * ((y[i] + y[i + 1]) / 2 - mid) / h[i] ** 2
        # the last row is not the mirror of the first: the weights stay in this order
        a[0, :2] = a[-1, -2:] = 11, 7
    else:
        raise ValueError(f"unknown boundary {kind}")
    return np.linalg.solve(a, b)


def cubic_pieces(x, y, sigma) -> np.ndarray:
    """Rows (a, b, c, d) of a + b t + c t^2 + d t^3 with t from each segment's left knot."""
    x, y, sigma = (np.asarray(v, float) for v in (x, y, sigma))
    h = np.diff(x)
    return np.column_stack((y[:-1], np.diff(y) / h - h * (2 * sigma[:-1] + sigma[1:]) / 6, sigma[:-1] / 2, np.diff(sigma) / (6 * h)))


def monotone_tangents(x, y) -> np.ndarray:
    """Tangents of the monotone cubic (Fritsch-Carlson), set from left to right."""
    x, y = check(x, y)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    if len(x) == 2:
        return np.full(2, d[0])
    m[1:-1] = np.where(d[:-1] * d[1:] <= 0, 0.0, (d[:-1] + d[1:]) / 2)

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        t = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return t if t * d0 > 0 and abs(t) <= 3 * abs(d0) else d0

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    for k in range(len(d)):
        if d[k] == 0:
            m[k] = m[k + 1] = 0.0
            continue
        a, b = m[k] / d[k], m[k + 1] / d[k]
        size = a * a + b * b
        if size > 9:
            m[k], m[k + 1] = 3 * a / np.sqrt(size) * d[k], 3 * b / np.sqrt(size) * d[k]
    return m


def hermite_pieces(x, y, m) -> np.ndarray:
    x, y, m = (np.asarray(v, float) for v in (x, y, m))
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    return np.column_stack((y[:-1], m[:-1], (3 * d - 2 * m[:-1] - m[1:]) / h, (m[:-1] + m[1:] - 2 * d) / h**2))


def convex_pieces(x, y) -> np.ndarray:
    """Monotone convex (Hagan-West) pieces of a cumulative curve: forwards at the nodes are kept within [0, 2 least]."""
    x, y = check(x, y)
    h, f = np.diff(x), np.diff(y) / np.diff(x)
    g = np.empty(len(x))
    if len(x) > 2:
        g[1:-1] = (h[:-1] * f[1:] + h[1:] * f[:-1]) / (h[:-1] + h[1:])
        g[0], g[-1] = (3 * f[0] - g[1]) / 2, (3 * f[-1] - g[-2]) / 2
        cap = 2 * np.minimum(f[:-1], f[1:])
        g[1:-1] = np.where(cap > 0, np.clip(g[1:-1], 0, np.maximum(cap, 0)), 0.0)
    else:
        g[:] = f[0]
    g[0], g[-1] = max(0.0, min(g[0], 2 * f[0])), max(0.0, min(g[-1], 2 * f[-1]))
    a, b = g[:-1] - f, g[1:] - f
    return np.column_stack((y[:-1], f + a, -(2 * a + b) / h, (a + b) / h**2))


def evaluate(x, pieces, q, flat: bool) -> np.ndarray:
    """Values at q; outside the knots the end values if flat, the end polynomials otherwise."""
    x, q = np.asarray(x, float), np.asarray(q, float)
    at = np.clip(np.searchsorted(x, q, "right") - 1, 0, len(x) - 2)
    t = (np.clip(q, x[0], x[-1]) if flat else q) - x[at]
    a, b, c, d = pieces[at].T
    return a + t * (b + t * (c + t * d))
