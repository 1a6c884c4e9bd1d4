"""Resampling as joins: index paths are pure functions of (seed, replicate, position), so any number of tasks can make them.

Series are (series, k, n, value) with k from 0, see series(). Replicates are
made with hash-based uniforms; ``exact`` replays one sequential PCG stream
over all replicates of a series in a kernel instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import normal
from ..kernels import quantiles, resample
from ..kernels.rng import Pcg64


def series(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """(series, k, n, value) in order; nulls go."""
    d = df.select(F.col(key).alias("series"), *order, F.col(value).cast("double").alias("value")).dropna()
    by = W.partitionBy("series")
    return d.select("series", (F.row_number().over(by.orderBy(*order)) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(by).alias("n"), "value")


def uniform(seed: int, *parts: Column) -> Column:
    """A uniform on [0, 1) from a hash of the seed and the parts."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11) * F.lit(2.0**-53)


def _replicates(s: DataFrame, count: int) -> DataFrame:
    """(series, n, rep, k): every place of every replicate."""
    sizes = s.groupBy("series").agg(F.max("n").alias("n"))
    reps = sizes.select("series", "n", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("rep"))
    return reps.select("series", "n", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))


def paths(s: DataFrame, count: int, kind: str = "iid", block: float = 1, seed: int = 0) -> DataFrame:
    """(series, rep, k, at): the place that each place of each replicate takes its value from.

    kind: iid, circular (blocks that wrap), moving (blocks within the series) or
    stationary (runs of mean length ``block``).
    """
    r = _replicates(s, count)
    if kind in ("iid", "circular", "moving"):
        b = 1 if kind == "iid" else int(block)
        if b < 1:
            raise ValueError("the block must have at least one element")
        room = F.col("n") - b + 1 if kind == "moving" else F.col("n")
        u = uniform(seed, F.col("series"), F.col("rep"), F.floor(F.col("k") / b))
        start = F.floor(u * F.when(room > 0, room).otherwise(F.raise_error(F.lit("the block must fit the series")).cast("long")))
        at = start + F.col("k") % b
        return r.select("series", "rep", "k", (at if kind == "moving" else at % F.col("n")).alias("at"))
    if kind != "stationary":
        raise ValueError(f"unknown resampler {kind}")
    if not block >= 1:
        raise ValueError("the mean block length must be at least 1")
    by = W.partitionBy("series", "rep").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    begins = (F.col("k") == 0) | (uniform(seed, F.col("series"), F.col("rep"), F.col("k"), F.lit(1)) < 1.0 / block)
    start = F.when(begins, F.struct(F.col("k").alias("k0"), F.floor(uniform(seed, F.col("series"), F.col("rep"), F.col("k")) * F.col("n")).alias("from")))
    last = F.last(start, ignorenulls=True).over(by)
    return r.withColumn("run", last).select("series", "rep", "k", ((F.col("run.from") + F.col("k") - F.col("run.k0")) % F.col("n")).alias("at"))


def exact_paths(s: DataFrame, count: int, kind: str = "iid", block: float = 1, seed: int = 0) -> DataFrame:
    """paths() from one sequential stream for each series, which all its replicates share in turn."""
    sizes = s.groupBy("series").agg(F.max("n").alias("n"))
    kinds = dict(sizes.dtypes)["series"]
    draw = {"iid": lambda g, n: resample.circular(g, n, 1), "circular": lambda g, n: resample.circular(g, n, int(block)), "moving": lambda g, n: resample.moving(g, n, int(block)), "stationary": lambda g, n: resample.stationary(g, n, block)}[kind]

    def run(frames):
        for f in frames:
            for one, n in zip(f.series, f.n, strict=True):
                g = Pcg64(seed)
                for rep in range(1, count + 1):
                    yield pd.DataFrame({"series": one, "rep": rep, "k": np.arange(n), "at": draw(g, int(n))})

    return sizes.mapInPandas(run, f"series {kinds}, rep int, k long, at long")


def resampled(s: DataFrame, path: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """(series, rep, k, value[, value2]): the values along the paths; a paired series takes the same places."""
    source = s.select("series", F.col("k").alias("at"), "value")
    out = path.join(source, ["series", "at"])
    if paired is not None:
        out = out.join(paired.select("series", F.col("k").alias("at"), F.col("value").alias("value2")), ["series", "at"])
    return out.drop("at")


def wild(s: DataFrame, count: int, kind: str = "mammen", seed: int = 0) -> DataFrame:
    """(series, rep, k, value): residuals times independent weights; mammen, rademacher or gaussian."""
    u = uniform(seed, F.col("series"), F.col("rep"), F.col("k"))
    root = 5.0**0.5
    weight = {
        "mammen": F.when(u < (root + 1) / (2 * root), -(root - 1) / 2).otherwise((root + 1) / 2),
        "rademacher": F.when(u < 0.5, -1.0).otherwise(1.0),
        "gaussian": normal.inverse(u + 2.0**-54),
    }[kind]
    reps = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("rep"))
    return reps.select("series", "rep", "k", (F.col("value") * weight).alias("value"))


def summary(stats: DataFrame, value: str = "statistic", keys: Sequence[str] = ("series",)) -> DataFrame:
    """(keys, count, mean, median, p05, p95) of replicated statistics."""
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return stats.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), p.alias("p")).select(*keys, "count", "mean", F.col("p")[1].alias("median"), F.col("p")[0].alias("p05"), F.col("p")[2].alias("p95"))


def monte_carlo(s: DataFrame, statistic: Column, count: int = 1000, kind: str = "iid", block: float = 1, seed: int = 0) -> DataFrame:
    """summary() of an aggregate of ``value`` over resamples; kind picks the resampler, IID by default."""
    return summary(resampled(s, paths(s, count, kind, block, seed)).groupBy("series", "rep").agg(statistic.alias("statistic")))


def monte_carlo_multi(s: DataFrame, statistics: Sequence[Column], names: Sequence[str] | None = None, count: int = 1000, kind: str = "iid", block: float = 1, seed: int = 0) -> DataFrame:
    """(series, name, count, mean, median, p05, p95): several statistics of each resample in one pass; names default to stat_0, ..."""
    names = list(names or (f"stat_{i}" for i in range(len(statistics))))
    wide = resampled(s, paths(s, count, kind, block, seed)).groupBy("series", "rep").agg(*(c.alias(f"__{i}") for i, c in enumerate(statistics)))
    long = wide.select("series", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"__{i}").alias("statistic")) for i, n in enumerate(names)))).alias("x")).select("series", "x.*")
    return summary(long, keys=("series", "name"))


def subsample(s: DataFrame, length: int, statistic) -> DataFrame:
    """(series, start, statistic) on every contiguous window; statistic(window) builds a windowed column, like lambda w: F.avg("value").over(w)."""
    if length < 1:
        raise ValueError("windows need at least one element")
    w = W.partitionBy("series").orderBy("k").rowsBetween(0, length - 1)
    return s.filter(F.col("n") > length).withColumn("statistic", statistic(w)).filter(F.col("k") <= F.col("n") - length).select("series", F.col("k").alias("start"), "statistic")


def subsample_length(n: Column) -> Column:
    """max(2, round(n^(2/3))), half to even."""
    return F.greatest(F.lit(2), F.bround(F.pow(n.cast("double"), F.lit(2.0 / 3.0))).cast("int"))


def tail_p(x: Column, target: Column, tail: str = "two_sided") -> Column:
    """The share of a group at or beyond the target: right, left or two_sided."""
    right, left = F.avg((x >= target).cast("double")), F.avg((x <= target).cast("double"))
    if tail == "right":
        return right
    if tail == "left":
        return left
    return F.least(F.lit(1.0), 2 * F.least(right, left))


def fast_double_bootstrap(s: DataFrame, statistic: Column, observed: DataFrame, outer: int = 200, tail: str = "two_sided", seed: int = 0) -> DataFrame:
    """(series, p, q, p_value): one inner resample for each outer one; observed: (series, observed)."""
    if outer < 50:
        raise ValueError("at least 50 outer resamples are needed")
    one = resampled(s, paths(s, outer, seed=seed))
    inner_path = paths(s, outer, seed=seed + 1)
    two = inner_path.join(one.select("series", "rep", F.col("k").alias("at"), "value"), ["series", "rep", "at"])
    a = one.groupBy("series", "rep").agg(statistic.alias("outer"))
    b = two.groupBy("series", "rep").agg(statistic.alias("inner"))
    both = a.join(b, ["series", "rep"]).join(observed, "series")
    p = both.groupBy("series").agg(tail_p(F.col("outer"), F.col("observed"), tail).alias("p"), F.array_sort(F.collect_list("inner")).alias("i"))
    # the inner quantile at p: count numbers for each series, a fixed size
    place = F.col("p") * (F.size("i") - 1)
    low = F.floor(place).cast("int")
    q = F.get("i", low) + (place - low) * (F.get("i", F.least(low + 1, F.size("i") - 1)) - F.get("i", low))
    q = p.select("series", "p", q.alias("q"))
    return a.join(q, "series").groupBy("series").agg(F.first("p").alias("p"), F.first("q").alias("q"), tail_p(F.col("outer"), F.col("q"), tail).alias("p_value"))


def block_length(s: DataFrame) -> DataFrame:
    """(series, length): Politis-White block length of series of at least 32 values; lags are counted by windows."""
    packed = s.filter("n >= 32").groupBy("series").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("v"))
    kind = dict(s.dtypes)["series"]

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"series": f.series, "length": [resample.politis_white([x["value"] for x in v]) for v in f.v]})

    return packed.mapInPandas(run, f"series {kind}, length double")


def harrell_davis(s: DataFrame, p: float) -> DataFrame:
    """(series, quantile): weights depend on (n, p) only and are joined to the ranks."""
    kind = "n long, r long, w double"

    def weights(frames):
        for f in frames:
            for n in f.n:
                w = quantiles.harrell_davis_weights(int(n), p)
                yield pd.DataFrame({"n": int(n), "r": np.arange(len(w)), "w": w})

    w = s.select("n").distinct().mapInPandas(weights, kind)
    rank = F.row_number().over(W.partitionBy("series").orderBy("value")) - 1
    return s.withColumn("r", rank.cast("long")).join(w, ["n", "r"]).groupBy("series").agg(F.sum(F.col("w") * F.col("value")).alias("quantile"))


def p_square(s: DataFrame, p: float) -> DataFrame:
    """(series, quantile): the marker estimate over each series in order."""
    packed = s.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("v"))
    kind = dict(s.dtypes)["series"]

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"series": f.series, "quantile": [quantiles.p_square([x["value"] for x in v], p) for v in f.v]})

    return packed.mapInPandas(run, f"series {kind}, quantile double")
