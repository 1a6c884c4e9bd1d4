"""Moments, correlation and simple regression as grouped aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def pairwise(*cols: Column) -> list[Column]:
    """Columns that are null unless all are numbers."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c)
    return [F.when(ok, c) for c in cols]


def welford(x) -> list[Column]:
    """count, mean, variance (0 under two values), population variance, deviation."""
    x = pairwise(_d(x))[0]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [F.count(x).alias("count"), zero(F.avg(x)).alias("mean"), zero(F.var_samp(x)).alias("variance"), zero(F.var_pop(x)).alias("variance_pop"), zero(F.stddev_samp(x)).alias("sd")]


def moment_state(x) -> Column:
    """A mergeable state: struct(count, mean, m2)."""
    x = pairwise(_d(x))[0]
    return F.struct(F.count(x).alias("count"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), (F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)).alias("m2"))


def merged(df: DataFrame, state: str, keys: Sequence[str]) -> DataFrame:
    """(keys, count, mean, variance) of all states of each group, empty ones included.

    Means are measured from their average in the group, found first, so that a
    variance far smaller than the squared mean keeps its digits; both passes
    combine before they shuffle.
    """
    of = lambda c: F.col(f"{state}.{c}")
    centre = df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(of("count") > 0, of("mean"))), F.lit(0.0)).alias("__centre")).select(F.struct(*keys).alias("__of"), "__centre")
    own = df.join(centre, F.struct(*keys).eqNullSafe(F.col("__of")))
    n, off, total = of("count"), of("mean") - F.col("__centre"), F.sum(of("count"))
    shift = F.coalesce(F.try_divide(F.sum(n * off), total), F.lit(0.0))
    spread = F.sum(of("m2")) + F.sum(n * off * off) - total * shift * shift
    return own.groupBy(*keys).agg(total.alias("count"), (F.first("__centre") + shift).alias("mean"), F.when(total > 1, spread / (total - 1)).otherwise(0.0).alias("variance"))


def sample_skewness(x, strict: bool = False) -> Column:
    """Adjusted skewness; null, or an error if strict, under three values or without spread."""
    x = pairwise(_d(x))[0]
    n = F.count(x).cast("double")
    bad = F.raise_error(F.lit("skewness needs three values that differ")).cast("double") if strict else F.lit(None).cast("double")
    return F.when((n >= 3) & (F.var_pop(x) > 0), F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(bad)


def sample_kurtosis(x, strict: bool = False) -> Column:
    """Adjusted excess kurtosis; null, or an error if strict, under four values or without spread."""
    x = pairwise(_d(x))[0]
    n = F.count(x).cast("double")
    bad = F.raise_error(F.lit("kurtosis needs four values that differ")).cast("double") if strict else F.lit(None).cast("double")
    return F.when((n >= 4) & (F.var_pop(x) > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)).otherwise(bad)


def _ratio(cov: Column, vx: Column, vy: Column, n: Column, least: int) -> Column:
    r = F.try_divide(cov, F.sqrt(vx * vy))
    return F.when((n >= least) & (vx > 0) & (vy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).otherwise(0.0)


def pearson(x, y) -> Column:
    """Correlation of a group; 0 under three pairs or without variance."""
    x, y = pairwise(_d(x), _d(y))
    return _ratio(F.covar_pop(x, y), F.var_pop(x), F.var_pop(y), F.count(x), 3)


def covariance(x, y) -> Column:
    """Sample covariance; 0 under two pairs."""
    x, y = pairwise(_d(x), _d(y))
    return F.coalesce(F.covar_samp(x, y), F.lit(0.0))


def rolling_pearson(df: DataFrame, x: str, y: str, width: int, keys: Sequence[str], order: Sequence[str], name: str = "pearson") -> DataFrame:
    """Correlation over each full window of ``width`` rows; 0 without variance."""
    if width < 2:
        raise ValueError("the window needs two rows")
    by = W.partitionBy(*keys).orderBy(*order)
    w = by.rowsBetween(-(width - 1), 0)
    a, b = _d(x), _d(y)
    r = _ratio(F.covar_pop(a, b).over(w), F.var_pop(a).over(w), F.var_pop(b).over(w), F.lit(width), 2)
    return df.filter(a.isNotNull() & b.isNotNull()).withColumn(name, r).withColumn("__n", F.row_number().over(by)).filter(F.col("__n") >= width).drop("__n")


def rolling_window(df: DataFrame, x: str, capacity: int, keys: Sequence[str], order: Sequence[str], name: str = "window") -> DataFrame:
    """The last ``capacity`` values, oldest first."""
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(capacity - 1), 0)
    return df.withColumn(name, F.collect_list(x).over(w))


def average_rank(x: str, keys: Sequence[str]) -> Column:
    """Ranks from 1, ties get their mean; one window, so peers are counted from the same sort."""
    by = W.partitionBy(*keys).orderBy(x)
    peers = W.partitionBy(*keys, x)
    return F.rank().over(by) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """(keys, spearman): Pearson of average ranks."""
    d = df.select(*keys, _d(x).alias("x"), _d(y).alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    d = d.withColumn("rx", average_rank("x", keys)).withColumn("ry", average_rank("y", keys))
    return d.groupBy(*keys).agg(pearson("rx", "ry").alias("spearman"))


def kendall(df: DataFrame, x: str, y: str, keys: Sequence[str], order: str = "t") -> DataFrame:
    """(keys, kendall): tau-b over all pairs of a group, in order of ``order`` (unique in a group)."""
    d = df.select(*keys, F.col(order).alias("o"), _d(x).alias("x"), _d(y).alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    e = d.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("o").alias("p"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    on = F.col("o") < F.col("p")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    dx, dy = F.signum(F.col("x") - F.col("x2")), F.signum(F.col("y") - F.col("y2"))
    sums = d.join(e, on).groupBy(*keys).agg(F.sum(dx * dy).alias("s"), F.sum(F.when(dx == 0, 1).otherwise(0)).alias("tx"), F.sum(F.when(dy == 0, 1).otherwise(0)).alias("ty"), F.count(F.lit(1)).cast("double").alias("pairs"))
    low = F.sqrt((F.col("pairs") - F.col("tx")) * (F.col("pairs") - F.col("ty")))
    tau = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("s"), low), F.lit(0.0))))
    return sums.select(*keys, F.when(F.col("pairs") >= 3, tau).otherwise(0.0).alias("kendall"))


def distance_correlation(df: DataFrame, x: str, y: str, keys: Sequence[str], order: str = "t") -> DataFrame:
    """(keys, distance_correlation) from doubly centred distances of all pairs of a group."""
    d = df.select(*keys, F.col(order).alias("o"), _d(x).alias("x"), _d(y).alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    e = d.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("o").alias("p"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    pairs = d.join(e, on).select(*keys, "o", "p", F.abs(F.col("x") - F.col("x2")).alias("a"), F.abs(F.col("y") - F.col("y2")).alias("b"))
    row, col, every = W.partitionBy(*keys, "o"), W.partitionBy(*keys, "p"), W.partitionBy(*keys)
    centred = lambda c: F.col(c) - F.avg(c).over(row) - F.avg(c).over(col) + F.avg(c).over(every)
    sums = pairs.select(*keys, centred("a").alias("a"), centred("b").alias("b")).groupBy(*keys).agg(F.avg(F.col("a") * F.col("b")).alias("ab"), F.avg(F.col("a") * F.col("a")).alias("aa"), F.avg(F.col("b") * F.col("b")).alias("bb"), F.count(F.lit(1)).alias("n"))
    low = F.col("aa") * F.col("bb")
    r = F.sqrt(F.greatest(F.lit(0.0), F.col("ab")) / F.sqrt(F.greatest(low, F.lit(1e-300))))
    return sums.select(*keys, F.when((F.col("n") >= 4) & (low > 1e-18), F.least(F.lit(1.0), r)).otherwise(0.0).alias("distance_correlation"))


def simple_regression(y, x) -> list[Column]:
    """slope, intercept and R squared of a group."""
    y, x = pairwise(_d(y), _d(x))
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")]


def percentile(x, p) -> Column:
    """Exact type-7 quantile, 0 for no values; p is clamped to [0, 1]."""
    return F.coalesce(F.percentile(pairwise(_d(x))[0], min(max(p, 0.0), 1.0)), F.lit(0.0))
