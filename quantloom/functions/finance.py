"""Correlation transforms, Sharpe-ratio statistics and two-point interpolation as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normal

EULER = 0.5772156649015329


def fisher_z(r: Column) -> Column:
    """ln((1 + r) / (1 - r)) / 2."""
    return F.lit(0.5) * F.ln(F.try_divide(F.lit(1.0) + r, F.lit(1.0) - r))


def fisher_inverse(z: Column) -> Column:
    return F.tanh(z)


def fisher_interval(r: Column, n: Column, level: float = 0.95) -> Column:
    """struct(low, high) of a correlation of n >= 4 pairs; (r, r) if |r| >= 1, null for fewer pairs."""
    if not 0 < level < 1:
        raise ValueError("level must lie in (0, 1)")
    width = normal.inverse(F.lit(0.5 + level / 2)) / F.sqrt(F.greatest(n - F.lit(3), F.lit(1)).cast("double"))
    z = fisher_z(r)
    exact = F.abs(r) >= 1
    pick = lambda x: F.when(n >= 4, F.when(exact, r).otherwise(x))
    return F.struct(pick(F.tanh(z - width)).alias("low"), pick(F.tanh(z + width)).alias("high"))


def two_point(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The line through two points, extended both ways; null where they share x (closer than 1e-12)."""
    return F.when(F.abs(x1 - x0) >= 1e-12, y0 + (x - x0) / (x1 - x0) * (y1 - y0))


def expected_max_sharpe(trials: Column) -> Column:
    """The expected largest of ``trials`` independent standard Sharpe ratios; 0 for one."""
    log = F.ln(F.greatest(trials, F.lit(1)).cast("double"))
    root = F.sqrt(F.lit(2.0) * log)
    return F.when(trials > 1, root * (F.lit(1.0) - F.try_divide(F.lit(EULER), log)) + F.try_divide(F.lit(EULER), root)).otherwise(0.0)


def deflated_sharpe(sharpe: Column, trials: Column, years: Column, skew: Column, kurtosis: Column, days: int = 252) -> Column:
    """struct(expected_max, deflated, p_value); kurtosis is the raw one, 3 for a normal."""
    trials = F.greatest(trials, F.lit(1))
    span = F.when(years > 0, years.cast("double")).otherwise(1.0) * days
    best = expected_max_sharpe(trials)
    raw = F.lit(1.0) - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    error = F.sqrt(F.when(raw < 0, F.lit(1.0)).otherwise(raw) / span)
    z = F.try_divide(sharpe - best, error)
    return F.struct(best.alias("expected_max"), (sharpe - best).alias("deflated"), (F.lit(1.0) - normal.cdf(z)).alias("p_value"))


def haircut_sharpe(sharpe: Column, trials: Column, years: Column, days: int = 252) -> Column:
    """struct(p_value, bonferroni, holm, bhy, haircut); one test alone gives Holm's first step, Bonferroni's."""
    n = F.greatest(trials, F.lit(1))
    scale = F.sqrt(F.when(years > 0, years.cast("double")).otherwise(1.0) * days)
    p = F.lit(1.0) - normal.cdf(sharpe * scale)
    harmonic = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / k)
    bonferroni = F.least(F.lit(1.0), p * n)
    bhy = F.least(F.lit(1.0), p * harmonic)
    edge = 1e-15
    z = normal.inverse(F.least(F.greatest(F.lit(1.0) - bhy, F.lit(edge)), F.lit(1.0 - edge)))
    cut = F.least(z / scale, sharpe)
    return F.struct(p.alias("p_value"), bonferroni.alias("bonferroni"), bonferroni.alias("holm"), bhy.alias("bhy"), cut.alias("haircut"))


def minimum_track_record(sharpe: Column, benchmark: Column, skew: Column, kurtosis: Column, level: float = 0.95, days: int = 252) -> Column:
    """Years of daily data until a Sharpe ratio exceeds a benchmark at ``level``; infinite if it does not."""
    raw = F.lit(1.0) - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe
    raw = F.when(raw < 0, F.lit(1.0)).otherwise(raw)
    z = normal.inverse(F.lit(level))
    gap = sharpe - benchmark
    return F.when(gap <= 0, F.lit(float("inf"))).otherwise((F.lit(1.0) + raw * F.try_divide(z * z, gap * gap)) / days)
