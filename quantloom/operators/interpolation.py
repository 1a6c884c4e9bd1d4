"""Curve interpolation: knots become a table of segments with cubic coefficients, queries are joined to their segment.

Knots (curve, x, y), queries (curve, q). Every kind gives a segment the
polynomial a + b t + c t^2 + d t^3 in t = q - x_left, of y or of ln y, so one
plan serves all. Segment tables are made by window functions where the kind is
local, and by a kernel per curve where tangents depend on the whole curve. The
lookup is as-of: a union of knots and queries sorted by position carries the
last segment forward, so it needs no range join and no broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..kernels import spline

KINDS = ("linear", "log_linear", "flat_forward", "monotone_cubic", "monotone_convex", "cubic")
_SEGMENT = ["curve", "x", "h", "a", "b", "c", "d"]


def _clean(knots: DataFrame) -> DataFrame:
    """One y for each x of a curve: the mean of repeats; nulls go."""
    return knots.select("curve", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna().groupBy("curve", "x").agg(F.avg("y").alias("y"))


def _local(knots: DataFrame, kind: str) -> DataFrame:
    """Segments of kinds that need only neighbours."""
    w = W.partitionBy("curve").orderBy("x")
    k = _clean(knots)
    if kind in ("log_linear", "flat_forward"):
        k = k.withColumn("y", F.ln("y"))
    h = F.lead("x").over(w) - F.col("x")
    slope = (F.lead("y").over(w) - F.col("y")) / h
    k = k.withColumn("h", h).withColumn("f", slope)
    zero = F.lit(0.0)
    if kind != "monotone_convex":
        return k.select("curve", "x", "h", F.col("y").alias("a"), F.coalesce("f", zero).alias("b"), zero.alias("c"), zero.alias("d"))
    # node forwards: interior means weighted by time, ends extrapolated, all kept within [0, 2 least neighbour]
    f0, h0 = F.lag("f").over(w), F.lag("h").over(w)
    raw = (h0 * F.col("f") + F.col("h") * f0) / (h0 + F.col("h"))
    k = k.withColumn("f0", f0).withColumn("raw", raw)
    inner = F.col("f0").isNotNull() & F.col("f").isNotNull()
    first = F.coalesce((3 * F.col("f") - F.lead("raw").over(w)) / 2, F.col("f"))
    last = F.coalesce((3 * F.col("f0") - F.lag("raw").over(w)) / 2, F.col("f0"))
    cap = 2 * F.least("f0", "f")
    g = F.when(inner, F.when(cap > 0, F.greatest(zero, F.least("raw", cap))).otherwise(zero)).when(F.col("f0").isNull(), F.greatest(zero, F.least(first, 2 * F.col("f")))).otherwise(F.greatest(zero, F.least(last, 2 * F.col("f0"))))
    k = k.withColumn("g", g).withColumn("g1", F.lead("g").over(w))
    a, b = F.col("g") - F.col("f"), F.col("g1") - F.col("f")
    return k.select("curve", "x", "h", F.col("y").alias("a"), F.coalesce(F.col("f") + a, zero).alias("b"), F.coalesce(-(2 * a + b) / F.col("h"), zero).alias("c"), F.coalesce((a + b) / (F.col("h") * F.col("h")), zero).alias("d"))


def _kernel(knots: DataFrame, kind: str, boundary: str, left: float, right: float) -> DataFrame:
    """Segments of kinds that need the whole curve."""
    k = _clean(knots)
    curve = dict(k.dtypes)["curve"]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x")
        x, y = frame.x.to_numpy(), frame.y.to_numpy()
        if len(x) == 1:
            rows = np.array([[y[0], 0.0, 0.0, 0.0]])
        else:
            pieces = spline.hermite_pieces(x, y, spline.monotone_tangents(x, y)) if kind == "monotone_cubic" else spline.cubic_pieces(x, y, spline.second_derivatives(x, y, boundary, left, right))
            rows = np.vstack((pieces, [y[-1], 0.0, 0.0, 0.0]))
        h = np.append(np.diff(x), np.nan)
        return pd.DataFrame({"curve": frame.curve.to_numpy(), "x": x, "h": pd.Series(h).where(~np.isnan(h), None), "a": rows[:, 0], "b": rows[:, 1], "c": rows[:, 2], "d": rows[:, 3]})

    return k.groupBy("curve").applyInPandas(one, f"curve {curve}, x double, h double, a double, b double, c double, d double")


def segments(knots: DataFrame, kind: str, boundary: str = "natural", left: float = 0.0, right: float = 0.0) -> DataFrame:
    """(curve, x, h, a, b, c, d): one row for each knot; the last has no length."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; one of {', '.join(KINDS)}")
    return _kernel(knots, kind, boundary, left, right) if kind in ("cubic", "monotone_cubic") else _local(knots, kind)


def lookup(segs: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (curve, q, ...) with the last segment at or before q, the first segment for those before it."""
    by = W.partitionBy("curve").orderBy("__at", "__q")
    seg = F.struct(*[c for c in _SEGMENT if c != "curve"])
    extra = [c for c in queries.columns if c != "curve"]
    left = segs.select("curve", F.col("x").alias("__at"), F.lit(0).alias("__q"), seg.alias("s"), *(F.lit(None).cast(dict(queries.dtypes)[c]).alias(c) for c in extra))
    right = queries.select("curve", F.col("q").cast("double").alias("__at"), F.lit(1).alias("__q"), F.lit(None).cast(left.schema["s"].dataType).alias("s"), *extra)
    both = left.unionByName(right)
    every = W.partitionBy("curve")
    first = F.min("s").over(every)  # the first segment, since x leads the struct
    end = F.max(F.struct(F.col("s.x"), F.col("s.a"))).over(every)
    # the last knot has no segment of its own: what lies behind it stays with the segment before
    real = F.last(F.when(F.col("s.h").isNotNull(), F.col("s")), ignorenulls=True).over(by)
    out = both.withColumn("__end", end).withColumn("__first", first).withColumn("__real", real).filter("__q = 1")
    return out.withColumn("s", F.coalesce("__real", "__first")).drop("__at", "__q", "__real")


def interpolate(knots: DataFrame, queries: DataFrame, kind: str = "linear", boundary: str = "natural", left: float = 0.0, right: float = 0.0, name: str = "value") -> DataFrame:
    """queries with the curve's value at q. Outside the knots the end value holds; a cubic goes on with its end polynomial."""
    at = lookup(segments(knots, kind, boundary, left, right), queries)
    q = F.col("q").cast("double")
    x = q if kind == "cubic" else F.greatest(F.least(q, F.col("__end.x")), F.col("__first.x"))
    t = x - F.col("s.x")
    value: Column = F.col("s.a") + t * (F.col("s.b") + t * (F.col("s.c") + t * F.col("s.d")))
    if kind != "cubic":
        value = F.when(q >= F.col("__end.x"), F.col("__end.a")).otherwise(value)
    if kind in ("log_linear", "flat_forward"):
        value = F.exp(value)
    return at.withColumn(name, value).drop("s", "__end", "__first")
