"""Numpy kernels against known values and independent formulas."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quantloom.kernels import fit, linalg, quantiles, resample, rng, roots, spectral, spline


def test_cholesky_and_solves():
    a = np.array([[4.0, 2, 0.6], [2, 5, 1], [0.6, 1, 3]])
    b = np.array([1.0, 2, 3])
    lower = linalg.cholesky(a)
    assert np.allclose(lower @ lower.T, a)
    assert np.allclose(linalg.cholesky_solve(lower, b), np.linalg.solve(a, b))
    assert np.allclose(linalg.solve(a, b), np.linalg.solve(a, b))
    p, order, rank = linalg.pivoted_cholesky(a)
    assert rank == 3 and np.allclose(p @ p.T, a[np.ix_(order, order)])
    v = np.outer([1.0, 2, 3], [1.0, 2, 3])
    assert linalg.pivoted_cholesky(v, 1e-9)[2] == 1
    with pytest.raises(ValueError):
        linalg.cholesky(-a)
    with pytest.raises(ValueError):
        linalg.solve(v, b)


def test_psd_projections():
    a = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1.0]])
    assert not linalg.is_psd(a) and not linalg.is_psd(np.ones((2, 3)))
    assert linalg.is_psd(linalg.eigen_clip(a), 1e-9)
    h = linalg.higham(a)
    assert np.allclose(h.diagonal(), 1) and linalg.is_psd(h, 1e-6)
    assert np.allclose(linalg.higham(np.eye(3)), np.eye(3))


def test_pca_signs_and_thresholds():
    x = np.random.default_rng(0).normal(size=(200, 4)) @ np.diag([3, 2, 1, 0.5])
    p = linalg.pca_returns(x)
    at = np.abs(p["vectors"]).argmax(axis=0)
    assert (p["vectors"][at, range(4)] > 0).all()
    assert np.isclose(p["cumulative"][-1], 1) and linalg.components_for(p["cumulative"], 0.5) == 1
    scores = linalg.project(x, p["vectors"], 2, p["mean"])
    assert np.allclose(scores.var(axis=0, ddof=1), p["values"][:2])
    with pytest.raises(ValueError):
        linalg.pca(np.array([[1.0, 2], [3, 4]]))


def test_ols_is_exact_and_checks_rank():
    r = np.random.default_rng(1)
    x = r.normal(size=(50, 3))
    y = x @ [1.0, -2, 3] + 0.5 + 0.1 * r.normal(size=50)
    got = linalg.ols(x, y)
    design = np.column_stack((np.ones(50), x))
    assert np.allclose(got["coefficients"], np.linalg.lstsq(design, y, rcond=None)[0])
    assert got["dof"] == 46 and 0 < got["r_squared"] < 1
    with pytest.raises(ValueError):
        linalg.ols(np.column_stack((x[:, 0], x[:, 0])), y)
    with pytest.raises(ValueError):
        linalg.ols(x[:3], y[:3])


@pytest.mark.parametrize("kind", ["natural", "not_a_knot", "modified_not_a_knot", "qspline", "clamped"])
def test_splines_meet_their_knots(kind):
    x = np.array([0.0, 1, 2.5, 3, 5])
    y = np.sin(x)
    pieces = spline.cubic_pieces(x, y, spline.second_derivatives(x, y, kind, math.cos(0), math.cos(5)))
    assert np.allclose(spline.evaluate(x, pieces, x, False), y)


def test_not_a_knot_reproduces_a_cubic():
    x = np.array([0.0, 1, 2.5, 3, 5])
    f = lambda t: t**3 - 2 * t + 1
    pieces = spline.cubic_pieces(x, f(x), spline.second_derivatives(x, f(x), "not_a_knot"))
    q = np.linspace(-1, 6, 20)
    assert np.allclose(spline.evaluate(x, pieces, q, False), f(q))


def test_monotone_cubic_stays_monotone():
    x, y = np.arange(6.0), np.array([0, 0.1, 0.1, 5, 5.2, 9])
    v = spline.evaluate(x, spline.hermite_pieces(x, y, spline.monotone_tangents(x, y)), np.linspace(0, 5, 200), True)
    assert (np.diff(v) >= -1e-12).all()


def test_root_finders_agree():
    f = lambda x, rows: x**3 - x - (2 + rows)
    lo, hi = np.ones(5), np.full(5, 3.0)
    want = roots.brent(f, lo, hi)["root"]
    for got in (roots.bisection(f, lo, hi), roots.newton_bracketed(f, lo, hi), roots.newton(f, hi), roots.secant(f, hi), roots.muller(f, hi)):
        assert got["converged"].all() and np.allclose(got["root"], want, atol=1e-9)
    lost = roots.brent(lambda x, rows: x * x + 1, lo, hi)  # no change of sign: every row fails by itself
    assert not lost["converged"].any() and np.isnan(lost["root"]).all()
    flat = roots.newton(lambda x, rows: np.ones_like(x), np.ones(1))
    assert not flat["converged"][0] and np.isnan(flat["estimated_error"][0])


def test_levenberg_marquardt_and_bounds():
    t = np.linspace(0, 4, 40)
    y = 2.5 * np.exp(-1.3 * t)
    got = fit.levenberg_marquardt(lambda p: p[0] * np.exp(-p[1] * t) - y, [1.0, 0.5])
    assert got["converged"] and np.allclose(got["parameters"], [2.5, 1.3], atol=1e-6)
    held = fit.levenberg_marquardt(lambda p: p[0] * np.exp(-p[1] * t) - y, [1.0, 0.5], upper=[2.0, 9.0])
    assert held["parameters"][0] <= 2.0
    with pytest.raises(ValueError):
        fit.levenberg_marquardt(lambda p: p, [np.nan])


def test_portfolio_weights():
    cov = np.diag([1.0, 2.0, 4.0])
    w = fit.min_variance(cov)
    assert np.allclose(w, np.array([4, 2, 1]) / 7)
    assert np.allclose(fit.min_variance(cov, 0.0, 0.4), [0.4, 0.4, 0.2])
    assert np.allclose(fit.mean_variance(cov, [1.0, 2, 3], 0.0, 0.1, 0.7), [0.1, 0.2, 0.7])
    assert np.isclose(fit.mean_variance(cov, [1.0, 2, 3], 5.0).sum(), 1)
    assert (fit.min_variance([[2.0]]) == [1.0]).all()


def test_quantiles():
    x = np.sort(np.random.default_rng(2).normal(size=101))
    assert quantiles.percentile(x, 0.25) == np.quantile(x, 0.25) and quantiles.percentile([], 0.5) == 0
    w = quantiles.harrell_davis_weights(20, 0.5)
    assert np.isclose(w.sum(), 1) and np.allclose(w, w[::-1])
    assert abs(quantiles.harrell_davis(x, 0.5) - np.median(x)) < 0.1
    stream = np.random.default_rng(3).normal(size=5000)
    assert abs(quantiles.p_square(stream, 0.9) - np.quantile(stream, 0.9)) < 0.06
    assert quantiles.p_square([3.0, 1, 2], 0.5) == 2
    with pytest.raises(ValueError):
        quantiles.p_square([np.nan], 0.5)


def test_random_streams():
    assert [rng.Pcg64(1, 5).next_u64() for _ in range(2)][0] == rng.Pcg64(1, 5).next_u64() != rng.Pcg64(1, 6).next_u64()
    g = rng.Xoshiro(7)
    h = rng.Xoshiro(7)
    h.jump()
    assert g.next_u64() != h.next_u64()
    v = np.array([rng.Pcg64(3).next_double() for _ in range(1)] + [0.5])
    assert (v >= 0).all() and (v < 1).all()
    s = rng.Pcg64(9)
    n = s.ints(3000, 6)
    assert n.min() == 0 and n.max() == 5 and np.bincount(n).min() > 400
    z = rng.Gaussian(rng.Pcg64(4)).batch(4000)
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05
    with pytest.raises(ValueError):
        s.next_int(0)


def test_resamplers():
    g = rng.Pcg64(1)
    c = resample.circular(g, 20, 5)
    assert ((np.diff(c.reshape(4, 5), axis=1) % 20) == 1).all()
    m = resample.moving(g, 20, 5)
    assert (np.diff(m.reshape(4, 5), axis=1) == 1).all() and m.max() < 20
    assert len(resample.stationary(g, 50, 4.0)) == 50
    w = resample.wild_weights(g, 4000)
    assert abs(w.mean()) < 0.06 and abs((w**2).mean() - 1) < 0.08
    with pytest.raises(ValueError):
        resample.moving(g, 4, 5)
    with pytest.raises(ValueError):
        resample.politis_white(np.ones(10))
    assert resample.politis_white(np.ones(40)) == 1.0
    assert 1 <= resample.politis_white(np.random.default_rng(0).normal(size=200)) <= 100


def test_spectral_estimators_are_symmetric_and_keep_variances():
    x = np.random.default_rng(5).normal(size=(120, 8)) * 0.01
    s = spectral.sample(x)
    for name, f in spectral.ESTIMATORS.items():
        c = f(x)
        assert np.allclose(c, c.T), name
        if name in ("denoised", "detoned", "tracy_widom", "quadratic_inverse"):
            assert np.allclose(c.diagonal(), s.diagonal()), name
    assert np.allclose(spectral.denoised(x[:, :2]), spectral.sample(x[:, :2]))
    assert np.allclose(spectral.nercome(x[:3]), spectral.sample(x[:3]))
    with pytest.raises(ValueError):
        spectral.poet(x, 8)
