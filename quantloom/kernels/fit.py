"""Nonlinear least squares and long-only portfolio weights: numpy only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def jacobian(r: Callable, x: np.ndarray) -> np.ndarray:
    """Central differences."""
    h = np.maximum(1e-8, np.abs(x) * np.sqrt(np.finfo(float).eps))
    return np.column_stack([(np.asarray(r(x + e)) - np.asarray(r(x - e))) / (2 * s) for e, s in zip(np.diag(h), h, strict=True)])


def levenberg_marquardt(r: Callable, start, jac: Callable | None = None, lower=None, upper=None, most: int = 200, f_tol: float = 1e-10, x_tol: float = 1e-10, g_tol: float = 1e-10, damping: float = 1e-3) -> dict:
    """Least squares of residuals r(x) with damped normal equations, damping by the gain ratio, and box bounds by clipping."""
    x = np.array(start, float)
    if not np.isfinite(x).all():
        raise ValueError("the start must be finite")
    lo = np.full(len(x), -np.inf) if lower is None else np.asarray(lower, float)
    hi = np.full(len(x), np.inf) if upper is None else np.asarray(upper, float)
    x = np.clip(x, lo, hi)
    slope = jac or (lambda p: jacobian(r, p))
    res = np.asarray(r(x), float)
    cost, lam, grow, taken, reason = 0.5 * res @ res, damping, 2.0, 0, "MaxIterations"
    j = slope(x)
    for _ in range(most):
        g, h = j.T @ res, j.T @ j
        if np.abs(g).max() <= g_tol:
            reason = "GradientTolerance"
            break
        d = h.diagonal().copy()
        d[d == 0] = 1.0
        moved = False
        while True:
            try:
                factor = np.linalg.cholesky(h + lam * np.diag(d))
                step = -np.linalg.solve(factor.T, np.linalg.solve(factor, g))
            except np.linalg.LinAlgError:
                step = None
            if step is not None:
                new = np.clip(x + step, lo, hi)
                step = new - x
                nres = np.asarray(r(new), float)
                ncost = 0.5 * nres @ nres
                want = -(step @ g) - 0.5 * step @ h @ step
                gain = (cost - ncost) / want if want > 0 else -1.0
                if np.isfinite(ncost) and ncost < cost and gain > 0:
                    lam = max(lam * max(1 / 3, 1 - (2 * gain - 1) ** 3), 1e-12)
                    grow, moved = 2.0, True
                    break
                if np.abs(step).max() <= x_tol * (x_tol + np.abs(x).max()):
                    break
            lam *= grow
            grow *= 2
            if lam > 1e16:
                break
        if not moved:
            reason = "DampingOverflow" if lam > 1e16 else "ParameterTolerance"
            break
        taken += 1
        small_f = cost - ncost <= f_tol * cost
        small_x = np.sqrt(step @ step) <= x_tol * (x_tol + np.sqrt(x @ x))
        x, res, cost = new, nres, ncost
        j = slope(x)
        if small_f or small_x:
            reason = "FunctionTolerance" if small_f else "ParameterTolerance"
            break
    ok = reason not in ("MaxIterations", "DampingOverflow")
    m, n = len(res), len(x)
    cov = None
    if ok and m > n:
        try:
            cov = np.linalg.inv(j.T @ j) * (2 * cost / (m - n))
        except np.linalg.LinAlgError:
            cov = None
    return {"parameters": x, "cost": float(cost), "residuals": res, "converged": ok, "iterations": taken, "reason": reason, "covariance": cov}


def _widen(n: int, low: float, high: float) -> tuple[float, float]:
    return min(low, 1 / n), max(high, 1 / n)


def _active_set(q: np.ndarray, c: np.ndarray, low: float, high: float, most: int) -> np.ndarray | None:
    """min w'qw / 2 - c'w with sum 1 and bounds: bounds are fixed and released one at a time by their multipliers."""
    n = len(c)
    state = np.zeros(n, int)  # -1 at the lower bound, 1 at the upper
    for _ in range(most):
        free = state == 0
        w = np.where(state < 0, low, np.where(state > 0, high, 0.0))
        k = int(free.sum())
        if not k:
            return None
        fixed = ~free
        a = np.zeros((k + 1, k + 1))
        a[:k, :k], a[:k, k], a[k, :k] = q[np.ix_(free, free)], -1.0, 1.0
        b = np.append(c[free] - q[np.ix_(free, fixed)] @ w[fixed], 1 - w[fixed].sum())
        try:
            got = np.linalg.solve(a, b)
        except np.linalg.LinAlgError:
            got = np.linalg.lstsq(a, b, rcond=None)[0]
        w[free] = got[:k]
        under, over = np.maximum(low - w, 0) * free, np.maximum(w - high, 0) * free
        worst = np.maximum(under, over)
        if worst.max() > 1e-12:
            i = int(worst.argmax())
            state[i] = -1 if under[i] > 0 else 1
            continue
        pull = q @ w - c - got[k]  # at the lower bound it must not be negative, at the upper not positive
        wrong = np.where(state < 0, -pull, np.where(state > 0, pull, 0.0))
        if wrong.max() <= 1e-12:
            return w
        state[int(wrong.argmax())] = 0
    return None


def min_variance(cov, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Weights of least variance, sum 1, in bounds that are widened to hold 1 / n; equal weights if none are found."""
    q = np.asarray(cov, float)
    n = len(q)
    if n == 1:
        return np.ones(1)
    low, high = _widen(n, low, high)
    w = _active_set(q, np.zeros(n), low, high, 4 * n + 4)
    return np.full(n, 1 / n) if w is None else w


def mean_variance(cov, means, aversion: float, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """max w'm - aversion / 2 w'cov w; without aversion the best assets are filled first."""
    q, c = np.asarray(cov, float), np.asarray(means, float)
    n = len(c)
    if n == 1:
        return np.ones(1)
    if aversion == 0:
        w = np.full(n, low)
        left = 1 - w.sum()
        for i in np.argsort(-c, kind="stable"):
            add = min(max(left, 0.0), high - low)
            w[i] += add
            left -= add
        return w
    low, high = _widen(n, low, high)
    w = _active_set(aversion * q, c, low, high, 6 * n + 6)
    if w is None:
        raise ValueError("no weights were found")
    return w
