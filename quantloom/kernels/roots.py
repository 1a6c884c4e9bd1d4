"""Scalar root finders for many problems at once: every iteration moves all open rows together.

The objective f(x, rows) gets points and the row numbers they belong to and
returns values. Each solver returns a dict of arrays: root, converged,
iterations, final_residual, estimated_error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Objective = Callable[[np.ndarray, np.ndarray], np.ndarray]


class _Run:
    """Rows that are still open, and the results."""

    def __init__(self, n: int):
        self.open = np.arange(n)
        self.root, self.residual, self.error = (np.full(n, np.nan) for _ in range(3))
        self.done, self.steps = np.zeros(n, bool), np.zeros(n, np.int64)

    def put(self, rows, x, f, error, ok: bool) -> None:
        self.root[rows], self.residual[rows], self.error[rows], self.done[rows] = x, f, error, ok

    def close(self, hit: np.ndarray) -> np.ndarray:
        """Rows of the open ones that stay open."""
        self.open = self.open[~hit]
        return ~hit

    def result(self) -> dict:
        return {"root": self.root, "converged": self.done, "iterations": self.steps, "final_residual": self.residual, "estimated_error": self.error}


def _bracket(f: Objective, lo, hi, tol: float) -> tuple[_Run, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.array(lo, float), np.array(hi, float)
    run = _Run(len(a))
    fa, fb = f(a, run.open), f(b, run.open)
    # a bracket without a change of sign has no root to find: its row stays NaN and not converged
    lost = ~(fa * fb <= 0) & ~(np.abs(fa) <= tol) & ~(np.abs(fb) <= tol)
    at_a, at_b = np.abs(fa) <= tol, np.abs(fb) <= tol
    run.put(np.flatnonzero(at_b), b[at_b], fb[at_b], 0.0, True)
    run.put(np.flatnonzero(at_a), a[at_a], fa[at_a], 0.0, True)
    keep = run.close(at_a | at_b | lost)
    return run, a[keep], b[keep], fa[keep], fb[keep]


def bisection(f: Objective, lo, hi, f_tol: float = 1e-12, x_tol: float = 1e-12, most: int = 200) -> dict:
    run, a, b, fa, _ = _bracket(f, lo, hi, f_tol)
    for _ in range(most):
        if not len(run.open):
            break
        x = a + (b - a) / 2
        fx = f(x, run.open)
        run.steps[run.open] += 1
        width = np.abs(b - a) / 2
        ok = (np.abs(fx) <= f_tol) | (width <= x_tol)
        run.put(run.open, x, fx, width, False)
        run.done[run.open[ok]] = True
        low = np.sign(fx) == np.sign(fa)
        a, fa, b = np.where(low, x, a), np.where(low, fx, fa), np.where(low, b, x)
        keep = run.close(ok)
        a, b, fa = a[keep], b[keep], fa[keep]
    return run.result()


def brent(f: Objective, lo, hi, tol: float = 1e-12, most: int = 100) -> dict:
    """Inverse quadratic or secant steps where they stay in the bracket and halve it, bisection otherwise."""
    run, a, b, fa, fb = _bracket(f, lo, hi, 0.0)
    c, fc = a.copy(), fa.copy()
    last = before = b - a
    for _ in range(most):
        if not len(run.open):
            break
        # b is the best point, c has the other sign
        swap = np.abs(fc) < np.abs(fb)
        a, b, c = np.where(swap, b, a), np.where(swap, c, b), np.where(swap, b, c)
        fa, fb, fc = np.where(swap, fb, fa), np.where(swap, fc, fb), np.where(swap, fb, fc)
        half = (c - b) / 2
        slack = 0.5 * tol + 2 * np.finfo(float).eps * np.abs(b)
        ok = (fb == 0) | (np.abs(half) <= slack)
        run.put(run.open, b, fb, np.abs(half), False)
        run.done[run.open[ok]] = True
        keep = run.close(ok)
        a, b, c, fa, fb, fc, half, slack, last, before = (v[keep] for v in (a, b, c, fa, fb, fc, half, slack, last, before))
        if not len(run.open):
            break
        run.steps[run.open] += 1
        with np.errstate(all="ignore"):
            s, q = fb / fa, fa / fc
            r = fb / fc
            secant = a == c
            p = np.where(secant, 2 * half * s, s * (2 * half * q * (q - r) - (b - a) * (r - 1)))
            d = np.where(secant, 1 - s, (q - 1) * (r - 1) * (s - 1))
            d, p = np.where(p > 0, -d, d), np.abs(p)
            step = p / d
            good = (np.abs(before) >= slack) & (np.abs(fa) > np.abs(fb)) & np.isfinite(step) & (2 * p < np.minimum(3 * half * d - np.abs(slack * d), np.abs(before * d)))
        before, last = np.where(good, last, half), np.where(good, step, half)
        a, fa = b, fb
        b = b + np.where(np.abs(last) > slack, last, np.copysign(slack, half))
        fb = f(b, run.open)
        same = np.sign(fb) == np.sign(fc)
        c, fc = np.where(same, a, c), np.where(same, fa, fc)
        before, last = np.where(same, b - a, before), np.where(same, b - a, last)
    return run.result()


def _slope(f: Objective, df: Objective | None, x, rows) -> np.ndarray:
    if df is not None:
        return df(x, rows)
    h = np.maximum(1e-8, 1e-8 * np.abs(x))
    return (f(x + h, rows) - f(x - h, rows)) / (2 * h)


def newton_bracketed(f: Objective, lo, hi, df: Objective | None = None, tol: float = 1e-12, most: int = 100) -> dict:
    """Newton steps from the midpoint; a step that leaves the bracket becomes a bisection."""
    run, a, b, fa, _ = _bracket(f, lo, hi, tol)
    x = (a + b) / 2
    for _ in range(most):
        if not len(run.open):
            break
        fx = f(x, run.open)
        run.steps[run.open] += 1
        low = np.sign(fx) == np.sign(fa)
        a, fa, b = np.where(low, x, a), np.where(low, fx, fa), np.where(low, b, x)
        with np.errstate(all="ignore"):
            new = x - fx / _slope(f, df, x, run.open)
        out = ~np.isfinite(new) | (new <= np.minimum(a, b)) | (new >= np.maximum(a, b))
        new = np.where(out, (a + b) / 2, new)
        error = np.abs(new - x)
        ok = (np.abs(fx) <= tol) | (np.abs(b - a) <= tol)
        run.put(run.open, x, fx, error, False)
        run.done[run.open[ok]] = True
        keep = run.close(ok)
        a, b, fa, x = a[keep], b[keep], fa[keep], new[keep]
    return run.result()


def newton(f: Objective, guess, df: Objective | None = None, tol: float = 1e-12, step_tol: float = 0.0, most: int = 100) -> dict:
    """Plain Newton; a flat or non-finite slope ends a row without convergence, its error is nan."""
    x = np.array(guess, float)
    run = _Run(len(x))
    for _ in range(most):
        if not len(run.open):
            break
        fx = f(x, run.open)
        ok = np.abs(fx) <= tol
        run.put(run.open, x, fx, run.error[run.open], False)
        run.done[run.open[ok]] = True
        run.error[run.open[ok]] = np.where(np.isnan(run.error[run.open[ok]]), 0.0, run.error[run.open[ok]])
        keep = run.close(ok)
        x, fx = x[keep], fx[keep]
        if not len(run.open):
            break
        run.steps[run.open] += 1
        d = _slope(f, df, x, run.open)
        flat = ~np.isfinite(d) | (np.abs(d) <= 1e-30)
        run.error[run.open[flat]] = np.nan
        keep = run.close(flat)
        x, fx, d = x[keep], fx[keep], d[keep]
        new = x - fx / d
        run.error[run.open] = np.abs(new - x)
        small = np.abs(new - x) < step_tol
        run.put(run.open[small], new[small], f(new[small], run.open[small]), np.abs(new - x)[small], True)
        keep = run.close(small)
        x = new[keep]
    return run.result()


def secant(f: Objective, first, second=None, tol: float = 1e-12, most: int = 50) -> dict:
    """From two points, or one and a small step aside."""
    x0 = np.array(first, float)
    x1 = x0 + np.maximum(1e-4, 1e-4 * np.abs(x0)) if second is None else np.array(second, float)
    run = _Run(len(x0))
    f0, f1 = f(x0, run.open), f(x1, run.open)
    for _ in range(most):
        if not len(run.open):
            break
        run.steps[run.open] += 1
        with np.errstate(all="ignore"):
            new = x1 - f1 * (x1 - x0) / (f1 - f0)
        lost = ~np.isfinite(new)
        run.put(run.open[lost], x1[lost], f1[lost], np.nan, False)
        run.done[run.open[lost & (np.abs(f1) < tol)]] = True
        keep = run.close(lost)
        x1, f1, new = x1[keep], f1[keep], new[keep]
        fx = f(new, run.open)
        error = np.abs(new - x1)
        ok = (np.abs(fx) < tol) | (error < tol)
        run.put(run.open, new, fx, error, False)
        run.done[run.open[ok]] = True
        keep = run.close(ok)
        x0, f0, x1, f1 = x1[keep], f1[keep], new[keep], fx[keep]
    return run.result()


def muller(f: Objective, guess, delta: float = 0.5, tol: float = 1e-12, most: int = 50) -> dict:
    """Parabolas through three points; of a negative discriminant the root of its size is taken."""
    x = np.array(guess, float)
    run = _Run(len(x))
    p = [x - delta, x + delta, x]
    v = [f(q, run.open) for q in p]
    for _ in range(most):
        if not len(run.open):
            break
        run.steps[run.open] += 1
        h1, h2 = p[1] - p[0], p[2] - p[1]
        with np.errstate(all="ignore"):
            d1, d2 = (v[1] - v[0]) / h1, (v[2] - v[1]) / h2
            a = (d2 - d1) / (h2 + h1)
            b = a * h2 + d2
            root = np.sqrt(np.abs(b * b - 4 * a * v[2]))
            low = np.where(np.abs(b + root) > np.abs(b - root), b + root, b - root)
            step = -2 * v[2] / low
        lost = ~np.isfinite(step)
        step = np.where(lost, 0.0, step)
        new = p[2] + step
        fx = f(new, run.open)
        ok = (np.abs(fx) < tol) | ((np.abs(step) < tol) & ~lost)
        run.put(run.open, new, fx, np.abs(step), False)
        run.done[run.open[ok]] = True
        keep = run.close(ok | lost)
        p, v = [p[1][keep], p[2][keep], new[keep]], [v[1][keep], v[2][keep], fx[keep]]
    return run.result()
