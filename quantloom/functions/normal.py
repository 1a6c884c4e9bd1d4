"""The standard normal distribution as native columns."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of erf by Laikov (2025, arXiv:2504.05068), as IEEE 754 bits.
_ERF_BITS = (
    0x403CB2FF7B83F273, 0x40BE50A62F3A7A4D, 0x411A4315ECBB06C2, 0x4173D88BBAE026B6, 0x41657CC4BDE32AAF, 0x41B69EE60F7A66C0,
    0x41AD43852D82E0E4, 0x41F5248E8C642C98, 0x41F0CFEDDB1CB1FB, 0x4224CB0372DE3573, 0x422145A5D6A78078, 0x4252D242E3B6388A,
    0x425126882C83534F, 0x4270098836DDA156, 0x426DA78609B5DD31, 0x428CF4591BF6EAB5, 0x428CBC9A8F83AC35,
)
ERF = [struct.unpack(">d", b.to_bytes(8, "big"))[0] for b in _ERF_BITS]
#: erf(x) = x / sqrt(x^2 + (p / q)^32); q is monic of degree 10, p of degree 6, both in x^2.
Q = [1.0, *ERF[:4], *ERF[5::2]]
P = [ERF[4], *ERF[6::2]]

# Acklam's rational approximation of the inverse, highest power first, and its split point.
SPLIT = 0.02425
CENTRE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

DENSITY = 0.3989422804014327
HALF_ROOT = 0.7071067811865475


def _horner(x: Column, terms) -> Column:
    out = F.lit(terms[0])
    for t in terms[1:]:
        out = out * x + F.lit(t)
    return out


def let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def pdf(x: Column) -> Column:
    """Density."""
    return F.lit(DENSITY) * F.exp(F.lit(-0.5) * x * x)


def erf(x: Column) -> Column:
    """Error function, to about 1e-16 absolute."""
    z = x * x
    return x / F.sqrt(z + F.pow(_horner(z, P) / _horner(z, Q), F.lit(32.0)))


def cdf(x: Column) -> Column:
    """Distribution function."""
    z = F.lit(0.5) * x * x
    r = _horner(z, P) / _horner(z, Q)
    return F.lit(0.5) * (F.lit(1.0) + x * F.lit(HALF_ROOT) / F.sqrt(z + F.pow(r, F.lit(32.0))))


def inverse(p: Column, strict: bool = False) -> Column:
    """Quantile of p in (0, 1): a rational start and two Newton steps; others are null, or an error if strict."""
    tail = F.least(p, F.lit(1.0) - p)
    outer = let(F.sqrt(F.lit(-2.0) * F.ln(tail)), lambda q: _horner(q, TAIL_TOP) / _horner(q, TAIL_BOTTOM))
    inner = let(p - F.lit(0.5), lambda c: c * _horner(c * c, CENTRE_TOP) / _horner(c * c, CENTRE_BOTTOM))
    upper = p > F.lit(1.0 - SPLIT)
    # the upper tail is the lower one mirrored
    side = F.when(upper, F.lit(1.0) - p).otherwise(p)
    x = F.when(tail < F.lit(SPLIT), outer).otherwise(inner)
    for _ in range(2):
        x = let(x, lambda v: v - (cdf(v) - side) / pdf(v))
    x = F.when(upper, -x).otherwise(x)
    bad = F.raise_error(F.lit("probability must lie in (0, 1)")).cast("double") if strict else F.lit(None).cast("double")
    return F.when((p > 0) & (p < 1), x).otherwise(bad)


def cdf_sql(x: str) -> str:
    """cdf() as SQL text."""

    def horner(z: str, terms) -> str:
        out = f"{terms[0]!r}::DOUBLE"
        for t in terms[1:]:
            out = f"({out} * {z} + {t!r}::DOUBLE)"
        return out

    z = f"(0.5::DOUBLE * ({x}) * ({x}))"
    return f"(0.5::DOUBLE * (1 + ({x}) * {HALF_ROOT}::DOUBLE / sqrt({z} + pow({horner(z, P)} / {horner(z, Q)}, 32))))"
