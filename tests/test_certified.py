"""Certified results of public statistical reference data sets (NIST StRD), those whose data follow a rule."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.kernels import linalg
from quantloom.operators import dense, moments

# fixed values: certified mean and deviation
UNIVARIATE = {
    "numacc1": ([10000001.0, 10000003.0, 10000002.0], 10000002.0, 1.0),
    "numacc2": ([1.2] + [1.1, 1.3] * 500, 1.2, 0.1),
    "numacc3": ([1000000.2] + [1000000.1, 1000000.3] * 500, 1000000.2, 0.1),
    "numacc4": ([10000000.2] + [10000000.1, 10000000.3] * 500, 10000000.2, 0.1),
}
# fixed values: departures from the polynomial 1 + x + ... + x^5 at 0..20, and certified standard errors for them
DEPARTURES = [759, -2048, 2048, -2048, 2523, -2048, 2048, -2048, 1838, -2048, 2048, -2048, 1838, -2048, 2048, -2048, 2523, -2048, 2048, -2048, 759]
ERRORS = [2152.32624678170, 2363.55173469681, 779.343524331583, 101.475507550350, 5.64566512170752, 0.112324854679312]
SIGMA = 2360.14502379268


def rounding(values: list[float], deviation: float) -> float:
    """The relative error that storing the values as doubles may make in their deviation, and 1e-14."""
    return 1e-14 + 8 * math.ulp(max(values)) / deviation


@pytest.mark.parametrize("name", sorted(UNIVARIATE))
def test_moments_are_as_certified(spark, name):
    values, mean, deviation = UNIVARIATE[name]
    d = spark.createDataFrame([("a", k % 7, v) for k, v in enumerate(values)], "g string, part int, x double").repartition(3)
    serial = d.agg(*moments.welford("x")).first()
    states = d.groupBy("g", "part").agg(moments.moment_state("x").alias("s"))
    merged = moments.merged(states, "s", ["g"]).first()
    for got in (serial, merged):
        assert got["count"] == len(values) and got["mean"] == pytest.approx(mean, rel=1e-14)
        assert math.sqrt(got["variance"]) == pytest.approx(deviation, rel=rounding(values, deviation))


def design() -> np.ndarray:
    return np.arange(21.0)[:, None] ** np.arange(1, 6)


@pytest.mark.parametrize(("scale", "bar"), [(0, 1e-9), (1, 1e-9), (100, 1e-8), (10000, 1e-6)])
def test_polynomials_are_as_certified(scale, bar):
    y = 1 + design().sum(axis=1) + scale * np.array(DEPARTURES, float)
    got = linalg.ols(design(), y)
    assert np.allclose(got["coefficients"], 1, rtol=bar, atol=0)
    assert np.allclose(got["standard_errors"], scale * np.array(ERRORS), rtol=1e-9, atol=1e-6)
    assert got["sigma"] == pytest.approx(scale * SIGMA, rel=1e-9, abs=1e-6)


def test_a_polynomial_of_falling_coefficients(spark):
    x = design()
    y = 1 + x @ (0.1 ** np.arange(1, 6))
    rows = [(1, float(b), *map(float, a)) for a, b in zip(x, y, strict=True)]
    d = spark.createDataFrame(rows, "m int, y double, x1 double, x2 double, x3 double, x4 double, x5 double")
    got = dense.ols(d, "y", [f"x{k}" for k in range(1, 6)], ["m"]).first()
    assert np.allclose(got.coefficients, 0.1 ** np.arange(6), rtol=1e-9, atol=0)


def test_empty_states_merge(spark):
    d = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("b", 0, None)], "g string, part int, x double")
    states = d.groupBy("g", "part").agg(moments.moment_state("x").alias("s"))
    got = {r.g: r for r in moments.merged(states, "s", ["g"]).withColumn("mean", F.round("mean", 12)).collect()}
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["variance"]) == (1, 2.0, 0.0)
    assert (got["b"]["count"], got["b"]["mean"], got["b"]["variance"]) == (0, 0.0, 0.0)
