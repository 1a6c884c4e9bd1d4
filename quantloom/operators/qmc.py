"""Quasi-random sequences as generators: every point depends on its number alone, so a range makes them in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 30
# Degree, coefficients and initial numbers of the primitive polynomials of dimensions 2 to 32 (Joe and Kuo).
POLYNOMIALS = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)), (5, 13, (1, 1, 1, 3, 11)), (5, 14, (1, 3, 5, 5, 31)),
    (6, 1, (1, 3, 3, 9, 7, 49)), (6, 13, (1, 1, 1, 15, 21, 21)), (6, 16, (1, 3, 1, 13, 27, 49)), (6, 19, (1, 1, 1, 15, 7, 5)), (6, 22, (1, 3, 1, 15, 13, 25)), (6, 25, (1, 1, 5, 5, 19, 61)),
    (7, 1, (1, 3, 7, 11, 23, 15, 103)), (7, 4, (1, 3, 7, 13, 13, 15, 69)), (7, 7, (1, 1, 3, 13, 7, 35, 63)), (7, 8, (1, 3, 5, 9, 1, 25, 53)), (7, 14, (1, 3, 1, 13, 9, 35, 107)), (7, 19, (1, 3, 1, 5, 27, 61, 31)),
    (7, 21, (1, 1, 5, 11, 19, 41, 61)), (7, 28, (1, 3, 5, 3, 3, 13, 69)), (7, 31, (1, 1, 7, 13, 1, 19, 1)), (7, 32, (1, 3, 7, 5, 13, 19, 59)), (7, 37, (1, 1, 3, 9, 25, 29, 41)), (7, 41, (1, 3, 5, 13, 23, 1, 55)), (7, 42, (1, 1, 3, 1, 13, 41, 17)),
)


def direction_numbers(dim: int) -> list[int]:
    """The direction integers of a dimension (from 1), most significant first."""
    if dim == 1:
        return [1 << (BITS - 1 - i) for i in range(BITS)]
    degree, a, m = POLYNOMIALS[dim - 2]
    v = [x << (BITS - 1 - i) for i, x in enumerate(m)]
    while len(v) < BITS:
        new = v[-degree] ^ (v[-degree] >> degree)
        for k in range(1, degree):
            if a >> (degree - 1 - k) & 1:
                new ^= v[-k]
        v.append(new)
    return v


def _sobol(gray: Column, dim: int) -> Column:
    out = F.lit(0)
    for i, v in enumerate(direction_numbers(dim)):
        out = out.bitwiseXOR(F.shiftright(gray, i).bitwiseAND(1).cast("int") * F.lit(v))
    return out / F.lit(float(1 << BITS))


def sobol(spark: SparkSession, n: int, dims: int, skip: int = 0) -> DataFrame:
    """(i, x1, x2, ...): points 1 + skip onwards; the origin is left out."""
    if not 1 <= dims <= len(POLYNOMIALS) + 1:
        raise ValueError(f"between 1 and {len(POLYNOMIALS) + 1} dimensions")
    if n + skip >= 1 << BITS:
        raise ValueError("the sequence has 2**30 points")
    gray = F.col("i").bitwiseXOR(F.shiftright("i", 1))
    return spark.range(1 + skip, 1 + skip + n).withColumnRenamed("id", "i").select("i", *(_sobol(gray, d + 1).alias(f"x{d + 1}") for d in range(dims)))


def primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def radical_inverse(i: Column, base: int, most: int) -> Column:
    """The digits of i in ``base`` mirrored at the point; ``most`` bounds i."""
    digits, power = 0, 1
    while power <= most:
        power *= base
        digits += 1
    out, scale = F.lit(0.0), 1.0 / base
    for k in range(digits):
        out = out + F.floor(i / F.lit(base**k)) % base * F.lit(scale)
        scale /= base
    return out


def halton(spark: SparkSession, n: int, dims: int, skip: int = 0) -> DataFrame:
    """(i, x1, x2, ...): points 1 + skip onwards in the first prime bases."""
    if not 1 <= dims <= 50:
        raise ValueError("between 1 and 50 dimensions")
    return spark.range(1 + skip, 1 + skip + n).withColumnRenamed("id", "i").select("i", *(radical_inverse(F.col("i"), b, n + skip).alias(f"x{d + 1}") for d, b in enumerate(primes(dims))))
