"""Backtest and time-series statistics as windows and aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finance


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with k, the place from 0, and n, the size of the series."""
    by = W.partitionBy(*keys)
    return df.withColumn("k", F.row_number().over(by.orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(by))


def automatic_lags(n: Column) -> Column:
    """max(1, floor(4 (n / 100)^(2/9)))."""
    return F.greatest(F.lit(1), F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int"))


def newey_west(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str], lags: int | None = None) -> DataFrame:
    """(keys, n, lags, variance): the variance of the mean with Bartlett weights.

    Each value meets its predecessors through one window that keeps the last
    ``lags`` values, so there is no self-join. For automatic lags the length of
    the longest series, one number, is counted first: it sets the window.
    """
    rows = df.select(*keys, *order, F.col(x).cast("double").alias("x")).dropna()
    d = numbered(rows, keys, order)
    d = d.withColumn("z", F.col("x") - F.avg("x").over(W.partitionBy(*keys)))
    count = automatic_lags(F.col("n")) if lags is None else F.lit(lags)
    d = d.withColumn("lags", F.least(count, F.col("n") - 1).cast("int"))
    if lags is None:
        longest = rows.groupBy(*keys).count().agg(F.max("count").alias("n"))
        most = longest.select(F.coalesce(automatic_lags(F.col("n")), F.lit(1))).first()[0]
    else:
        most = max(lags, 1)
    past = F.collect_list("z").over(W.partitionBy(*keys).orderBy("k").rowsBetween(-most, -1))
    d = d.withColumn("past", F.reverse(past))
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size("past"), F.col("lags")), F.lit(1))), F.lit(0.0), lambda acc, l: acc + F.coalesce((1 - l / (F.col("lags") + 1)) * F.get("past", l - 1), F.lit(0.0)))
    own = F.col("z") * F.col("z") + F.when(F.col("lags") > 0, 2 * F.col("z") * terms).otherwise(0.0)
    return d.select(*keys, "n", "lags", own.alias("g")).groupBy(*keys).agg(F.first("n").alias("n"), F.first("lags").alias("lags"), (F.sum("g") / F.first("n") / F.first("n")).alias("variance"))


def drawdown(df: DataFrame, r: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with wealth (compounded from 1), peak and drawdown; returns are over -1."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("wealth", F.exp(F.sum(F.log1p(r)).over(w)))
    d = d.withColumn("peak", F.greatest(F.lit(1.0), F.max("wealth").over(w)))
    return d.withColumn("drawdown", (F.col("peak") - F.col("wealth")) / F.col("peak"))


def generalization_score(df: DataFrame, r: str, keys: Sequence[str], order: Sequence[str], periods: int = 12, days: float = 252.0, weights=(0.3, 0.3, 0.2, 0.2)) -> DataFrame:
    """(keys, score, performance, significance, consistency, downside)."""
    d = numbered(df.select(*keys, *order, F.col(r).cast("double").alias("r")).dropna(), keys, order)
    d = drawdown(d, "r", keys, ["k"])
    # the last period takes the remainder; a series shorter than the periods is one period
    size = F.greatest(F.floor(F.col("n") / periods), F.lit(1))
    p = F.when(F.col("n") < periods, 0).otherwise(F.least(F.floor(F.col("k") / size), F.lit(periods - 1)))
    by_period = d.withColumn("__p", p).groupBy(*keys, "__p").agg(F.sum("r").alias("__sum"), F.max("drawdown").alias("__dd"))
    mean = d.groupBy(*keys).agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.count("r").alias("n"))
    agg = by_period.groupBy(*keys).agg(F.avg(F.when(F.col("__sum") > 0, 1.0).otherwise(0.0)).alias("share"), F.max("__dd").alias("dd")).join(mean, list(keys))
    sharpe = F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * F.sqrt(F.lit(days))).otherwise(0.0)
    t = F.when(F.col("sd") > 0, F.col("m") / (F.col("sd") / F.sqrt(F.col("n").cast("double")))).otherwise(0.0)
    a, b, c, e = weights
    parts = [(F.lit(a) * sharpe).alias("performance"), (F.lit(b) * F.greatest(F.lit(0.0), t) / F.sqrt(F.col("n").cast("double")) * F.sqrt(F.lit(days))).alias("significance"), (F.lit(c) * F.col("share")).alias("consistency"), (F.lit(e) * F.col("dd")).alias("downside")]
    out = agg.filter("n >= 2").select(*keys, *parts)
    return out.withColumn("score", F.col("performance") + F.col("significance") + F.col("consistency") - F.col("downside"))


def deflated_sharpe_returns(df: DataFrame, r: str, keys: Sequence[str], trials: int, days: int = 252) -> DataFrame:
    """(keys, sharpe, expected_max, deflated, p_value) of series of at least four returns, with population moments."""
    x = F.col(r).cast("double")
    m = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt")).filter("n >= 4 and sd > 0")
    m = m.withColumn("sharpe", F.col("m") / F.col("sd") * F.sqrt(F.lit(float(days))))
    got = finance.deflated_sharpe(F.col("sharpe"), F.lit(trials), F.col("n") / F.lit(float(days)), F.col("skew"), F.col("kurt"), days)
    return m.select(*keys, "sharpe", got.alias("g")).select(*keys, "sharpe", "g.*")


def overfitting(df: DataFrame, strategy: str, order: str, r: str, splits: int = 16) -> DataFrame:
    """(pbo, median_logit, combinations) by combinatorially symmetric cross-validation over all strategies.

    Each strategy's series must divide evenly into ``splits`` blocks. Block Sharpe
    ratios are one aggregate; the combinations are a table whose size depends on
    ``splits`` alone.
    """
    if splits < 2 or splits % 2:
        raise ValueError("the number of splits must be positive and even")
    d = numbered(df.select(F.col(strategy).alias("s"), F.col(order).alias("o"), F.col(r).cast("double").alias("r")), ["s"], ["o"])
    size = F.when(F.col("n") % splits == 0, F.col("n") / splits).otherwise(F.raise_error(F.lit("the time length must be divisible by the splits")).cast("double"))
    sharpe = F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")), F.lit(0.0))
    blocks = d.withColumn("block", F.floor(F.col("k") / size).cast("int")).groupBy("s", "block").agg(sharpe.alias("v"))
    packed = blocks.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("block", "v"))).alias("b")).select("s", F.transform("b", lambda x: x["v"]).alias("v"))
    spark = df.sparkSession
    half = list(combinations(range(splits), splits // 2))
    combos = spark.createDataFrame([(i, [float(b in c) for b in range(splits)]) for i, c in enumerate(half)], "combo int, inside array<double>")
    dot = lambda take: F.aggregate(F.zip_with("v", "inside", take), F.lit(0.0), lambda acc, x: acc + x) / (splits // 2)
    # every strategy is asked under every combination; the combinations' number is fixed by splits
    scored = packed.withColumn("one", F.lit(1)).join(F.broadcast(combos.withColumn("one", F.lit(1))), "one").select("combo", "s", dot(lambda v, i: v * i).alias("inner"), dot(lambda v, i: v * (1 - i)).alias("outer"))
    best = scored.groupBy("combo").agg(F.max("inner").alias("top"), F.count(F.lit(1)).alias("n"))
    winner = scored.join(best.select("combo", "top", "n"), "combo").filter(F.col("inner") == F.col("top")).groupBy("combo").agg(F.min(F.struct("s", "outer")).alias("w"), F.first("n").alias("n"))
    rank = scored.join(winner, "combo").groupBy("combo").agg(
        F.first("n").alias("n"),
        (F.count_if((F.col("outer") < F.col("w.outer")) | ((F.col("outer") == F.col("w.outer")) & (F.col("s") < F.col("w.s")))) + 1).alias("rank"),
    )
    omega = F.col("rank") / (F.col("n") + 1)
    logits = rank.select(F.ln(omega / (1 - omega)).alias("logit"))
    # the upper median: the element at place count / 2 in sorted order
    return logits.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.array_sort(F.collect_list("logit")).alias("l")).select("pbo", F.get("l", F.floor(F.size("l") / 2).cast("int")).alias("median_logit"), F.size("l").cast("long").alias("combinations"))
