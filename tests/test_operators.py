"""Spark operators against numpy on small tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import finance, normal
from quantloom.kernels import spectral
from quantloom.operators import backtest, bootstrap, covariance, dense, interpolation, moments, qmc, roots


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 4)) @ np.array([[1, 0.3, 0, 0], [0, 1, 0.2, 0], [0, 0, 1, 0.5], [0, 0, 0, 1]]) * 0.02
    rows = [("p", t, f"a{j}", float(x[t, j])) for t in range(60) for j in range(4)]
    return x, spark.createDataFrame(rows, "panel string, t long, asset string, value double").cache()


def matrix(df, n=4):
    out = np.zeros((n, n))
    for r in df.collect():
        out[int(r.i[1:]), int(r.j[1:])] = out[int(r.j[1:]), int(r.i[1:])] = r.value
    return out


def test_normal(spark):
    x = np.linspace(-5, 5, 21)
    got = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", normal.cdf(F.col("x")).alias("c"), normal.inverse(normal.cdf(F.col("x"))).alias("back")).toPandas()
    assert np.allclose(got.c, [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in got.x], atol=2e-15)
    assert np.allclose(got.back, got.x, atol=1e-7)
    assert spark.range(1).select(normal.inverse(F.lit(1.0)).alias("v")).first().v is None


def test_moments_edges(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("b", 2.0), ("c", None)], "k string, x double")
    got = {r.k: r for r in d.groupBy("k").agg(*moments.welford("x"), moments.sample_skewness("x").alias("s"), moments.pearson("x", "x").alias("r"), moments.percentile("x", 0.5).alias("q")).collect()}
    assert got["a"].variance == 0 and got["b"].s is None and got["b"].r == 0 and got["c"]["count"] == 0 and got["c"].q == 0


@pytest.mark.parametrize("kind", sorted(covariance.PLANS))
def test_covariance_plans(panel, kind):
    x, df = panel
    got = matrix(covariance.PLANS[kind](df))
    s = spectral.sample(x)
    if kind == "sample":
        assert np.allclose(got, s)
    elif kind == "shrink_identity":
        assert np.allclose(got, spectral.identity_shrinkage(x))
    else:
        assert np.isfinite(got).all() and np.linalg.eigvalsh(got).min() > 0


@pytest.mark.parametrize("kind", sorted(spectral.ESTIMATORS))
def test_spectral_operators(panel, kind):
    x, df = panel
    assert np.allclose(matrix(dense.spectral_covariance(df, kind)), spectral.ESTIMATORS[kind](x))


def test_pca_and_scores(panel):
    x, df = panel
    p = dense.pca_returns(df)
    rows = p.orderBy("k").collect()
    assert np.allclose([r.eigenvalue for r in rows], np.linalg.eigvalsh(spectral.sample(x))[::-1])
    s = dense.project(df, p, 1).orderBy("t").toPandas().score
    assert np.allclose(s, (x - x.mean(axis=0)) @ np.array(rows[0].vector))


def test_rank_correlations(spark):
    r = np.random.default_rng(2)
    x, y = r.integers(0, 8, 40).astype(float), r.integers(0, 8, 40).astype(float)
    d = spark.createDataFrame(pd.DataFrame({"g": "g", "t": range(40), "x": x, "y": y}))
    s = [(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]), x[i] == x[j], y[i] == y[j]) for i in range(40) for j in range(i)]
    n = len(s)
    tau = sum(a for a, _, _ in s) / math.sqrt((n - sum(b for _, b, _ in s)) * (n - sum(c for _, _, c in s)))
    assert np.isclose(moments.kendall(d, "x", "y", ["g"]).first().kendall, tau)
    rank = lambda v: pd.Series(v).rank().to_numpy()
    assert np.isclose(moments.spearman(d, "x", "y", ["g"]).first().spearman, np.corrcoef(rank(x), rank(y))[0, 1])


@pytest.mark.parametrize("kind", ["linear", "log_linear", "monotone_cubic", "monotone_convex", "cubic"])
def test_interpolation_ends_and_knots(spark, kind):
    knots = spark.createDataFrame([("c", float(x), float(y)) for x, y in ((0, 1), (1, 2), (3, 2.5), (4, 4))], "curve string, x double, y double")
    q = spark.createDataFrame([("c", float(v)) for v in (-1, 0, 1, 2, 3, 4, 9)], "curve string, q double")
    got = interpolation.interpolate(knots, q, kind).orderBy("q").toPandas().value.to_numpy()
    assert np.allclose(got[[1, 2, 4, 5]], [1, 2, 2.5, 4])
    if kind != "cubic":
        assert got[0] == 1 and np.isclose(got[6], 4)
    if kind == "linear":
        assert np.isclose(got[3], 2.25)


def test_newey_west_and_overfitting(spark):
    r = np.random.default_rng(3).normal(size=(3, 24))
    d = spark.createDataFrame([(f"s{i}", t, float(r[i, t])) for i in range(3) for t in range(24)], "s string, t long, r double")
    z = r[0] - r[0].mean()
    want = (z @ z + sum(2 * (1 - k / 3) * (z[k:] @ z[:-k]) for k in (1, 2))) / 24 / 24
    assert np.isclose(backtest.newey_west(d, "r", ["s"], ["t"], 2).filter("s = 's0'").first().variance, want)
    p = backtest.overfitting(d, "s", "t", "r", splits=4).first()
    assert p.combinations == 6 and 0 <= p.pbo <= 1


def test_drawdown_and_score(spark):
    d = spark.createDataFrame([("a", t, v) for t, v in enumerate((0.1, -0.5, 0.2, 0.3))], "s string, t long, r double")
    g = backtest.generalization_score(d, "r", ["s"], ["t"]).first()
    assert np.isclose(g.downside, 0.2 * 0.5) and np.isclose(g.consistency, 0.2)


def test_bootstrap_paths(spark):
    d = spark.createDataFrame([("a", t, float(t)) for t in range(30)], "s string, t long, v double")
    s = bootstrap.series(d, "s", ["t"], "v")
    one = bootstrap.paths(s, 5, "stationary", 4.0, 3).orderBy("rep", "k").collect()
    two = bootstrap.paths(s.repartition(3), 5, "stationary", 4.0, 3).orderBy("rep", "k").collect()
    assert one == two and len(one) == 150
    m = bootstrap.paths(s, 3, "moving", 5).toPandas()
    assert m["at"].between(0, 29).all()
    got = bootstrap.monte_carlo(s, F.avg("value"), 200).first()
    assert got["count"] == 200 and got.p05 < got.median < got.p95 and abs(got["mean"] - 14.5) < 1
    assert bootstrap.subsample(s, 10, lambda w: F.avg("value").over(w)).count() == 21
    fdb = bootstrap.fast_double_bootstrap(s, F.avg("value"), s.groupBy("series").agg(F.lit(14.5).alias("observed")), 60).first()
    assert 0 <= fdb.p_value <= 1
    exact = bootstrap.exact_paths(s, 2, "iid", seed=1)
    assert exact.count() == 60


def test_sequences(spark):
    s = qmc.sobol(spark, 4, 2).orderBy("i").collect()
    assert [r.x1 for r in s] == [0.5, 0.75, 0.25, 0.375]
    h = qmc.halton(spark, 4, 2).orderBy("i").collect()
    assert np.allclose([r.x2 for r in h], [1 / 3, 2 / 3, 1 / 9, 4 / 9])
    with pytest.raises(ValueError):
        qmc.sobol(spark, 4, 33)


def test_roots_operator(spark):
    d = spark.range(5).withColumn("lower", F.lit(0.0)).withColumn("upper", F.lit(3.0))
    got = roots.solve(d, lambda x, rows: x**2 - rows["id"].to_numpy() - 1, "brent").toPandas()
    assert np.allclose(got.root**2, got.id + 1)


def test_sharpe_statistics(spark):
    one = spark.range(1)
    r = one.select(finance.deflated_sharpe(F.lit(1.0), F.lit(1), F.lit(2.0), F.lit(0.0), F.lit(3.0)).alias("d"), finance.haircut_sharpe(F.lit(0.2), F.lit(1), F.lit(1.0)).alias("h"), finance.minimum_track_record(F.lit(0.1), F.lit(0.2), F.lit(0.0), F.lit(3.0)).alias("m")).first()
    assert r.d.expected_max == 0 and np.isclose(r.h.haircut, 0.2) and r.m == math.inf


def test_a_row_without_a_root_fails_alone(spark):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0), (3, 9.0)], "k int, c double").withColumn("lower", F.lit(0.0)).withColumn("upper", F.lit(10.0)).coalesce(1)
    for method in ("bisection", "brent", "newton_bracketed"):
        got = {r.k: r for r in roots.solve(df, lambda x, rows: x * x - rows["c"].to_numpy(), method).collect()}
        assert got[1].converged and got[3].converged and abs(got[3].root - 3) < 1e-6
        assert not got[2].converged and (got[2].root is None or got[2].root != got[2].root)
