"""Covariance of return panels as relational plans: one shuffle by time, one by pair of assets.

Panels are long, (panel, t, asset, value), and complete: every asset has a
value at each t. Only pairs with i <= j are made; mirror() adds the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ["panel", "i", "j"]


def _wide_pairs(centred: DataFrame) -> DataFrame:
    """Pairs i <= j of each time's values, made from one packed row for each time instead of a self-join."""
    packed = centred.groupBy("panel", "t").agg(F.array_sort(F.collect_list(F.struct("asset", "z"))).alias("v"), F.first("w").alias("w"))
    a = packed.select("panel", "t", "w", "v", F.posexplode("v").alias("p", "a"))
    rest = F.slice("v", F.col("p") + 1, F.size("v"))
    return a.select("panel", "t", "w", "a", F.explode(rest).alias("b")).select("panel", "t", "w", F.col("a.asset").alias("i"), F.col("b.asset").alias("j"), F.col("a.z").alias("zi"), F.col("b.z").alias("zj"))


def centred(panel: DataFrame) -> DataFrame:
    """Values less the asset's mean; z, and w = 1."""
    mean = F.avg("value").over(W.partitionBy("panel", "asset"))
    return panel.select("panel", "t", "asset", (F.col("value") - mean).alias("z"), F.lit(1.0).alias("w"))


def mirror(cov: DataFrame) -> DataFrame:
    """Both (i, j) and (j, i)."""
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    keep = [c for c in cov.columns if c not in ("i", "j")]
    return cov.select(*keep, F.explode(both).alias("__p")).select("panel", "__p.i", "__p.j", *[c for c in keep if c != "panel"])


def sample(panel: DataFrame) -> DataFrame:
    """(panel, i, j, value): sums of products over T - 1."""
    return _wide_pairs(centred(panel)).groupBy(*PAIR).agg((F.sum(F.col("zi") * F.col("zj")) / (F.count(F.lit(1)) - 1)).alias("value"))


def ewma(panel: DataFrame, decay: float = 0.94) -> DataFrame:
    """Exponential weights decay**(T - 1 - k), normalised, around plain means."""
    if not 0 < decay < 1:
        raise ValueError("the decay must lie in (0, 1)")
    age = F.row_number().over(W.partitionBy("panel", "asset").orderBy(F.col("t").desc())) - 1
    z = centred(panel).withColumn("w", F.pow(F.lit(decay), age))
    return _wide_pairs(z).groupBy(*PAIR).agg((F.sum(F.col("w") * F.col("zi") * F.col("zj")) / F.sum("w")).alias("value"))


def _pi(panel: DataFrame, s: DataFrame) -> DataFrame:
    """(panel, i, j, value, pi, n): sample covariances, the mean squared error of their terms, and T."""
    pairs = _wide_pairs(centred(panel))
    return pairs.join(s, PAIR).groupBy(*PAIR).agg(F.first("value").alias("value"), F.avg(F.pow(F.col("zi") * F.col("zj") - F.col("value"), F.lit(2.0))).alias("pi"), F.count(F.lit(1)).alias("n"))


def _shrink(p: DataFrame, extra: str = "0.0") -> DataFrame:
    """p: (panel, i, j, value, pi, n, target); towards target by clip((sum pi - extra) / (T sum (value - target)^2))."""
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    gap = twice * F.pow(F.col("value") - F.col("target"), F.lit(2.0))
    sums = p.groupBy("panel").agg(F.sum(twice * F.col("pi")).alias("sum_pi"), F.sum(F.when(F.col("i") == F.col("j"), F.col("pi")).otherwise(0.0)).alias("diag_pi"), F.sum(gap).alias("gamma"), F.first("n").alias("t_n"))
    raw = (F.col("sum_pi") - F.expr(extra)) / (F.col("t_n") * F.col("gamma"))
    delta = F.when(F.col("gamma") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(1.0)
    d = sums.select("panel", delta.alias("delta"))
    return p.join(d, "panel").select(*PAIR, (F.col("delta") * F.col("target") + (1 - F.col("delta")) * F.col("value")).alias("value"), "delta")


def shrink_identity(panel: DataFrame) -> DataFrame:
    """Ledoit-Wolf towards the scaled identity."""
    p = _pi(panel, sample(panel))
    diag = p.filter("i = j").groupBy("panel").agg(F.avg("value").alias("mu"))
    return _shrink(p.join(diag, "panel").withColumn("target", F.when(F.col("i") == F.col("j"), F.col("mu")).otherwise(0.0)), "diag_pi")


def _with_sd(p: DataFrame) -> DataFrame:
    sd = p.filter("i = j").select("panel", F.col("i").alias("k"), F.sqrt("value").alias("sd"))
    a, b = sd.select("panel", F.col("k").alias("i"), F.col("sd").alias("si")), sd.select("panel", F.col("k").alias("j"), F.col("sd").alias("sj"))
    return p.join(a, ["panel", "i"]).join(b, ["panel", "j"])


def shrink_constant_correlation(panel: DataFrame) -> DataFrame:
    """Towards the mean correlation of all pairs."""
    p = _with_sd(_pi(panel, sample(panel)))
    off = p.filter("i <> j").groupBy("panel").agg(F.avg(F.coalesce(F.try_divide(F.col("value"), F.col("si") * F.col("sj")), F.lit(0.0))).alias("r"))
    target = F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(F.coalesce("r", F.lit(0.0)) * F.col("si") * F.col("sj"))
    return _shrink(p.join(off, "panel", "left").withColumn("target", target))


def shrink_single_factor(panel: DataFrame) -> DataFrame:
    """Towards one factor, the mean of all assets at each time."""
    z = centred(panel).withColumn("m", F.avg("z").over(W.partitionBy("panel", "t")))
    var = z.groupBy("panel", "t").agg(F.first("m").alias("m")).groupBy("panel").agg((F.sum(F.col("m") * F.col("m")) / (F.count(F.lit(1)) - 1)).alias("vm"))
    beta = z.groupBy("panel", "asset").agg((F.sum(F.col("z") * F.col("m")) / (F.count(F.lit(1)) - 1)).alias("c")).join(var, "panel").select("panel", "asset", F.coalesce(F.try_divide("c", "vm"), F.lit(0.0)).alias("b"), "vm")
    p = _pi(panel, sample(panel))
    p = p.join(beta.select("panel", F.col("asset").alias("i"), F.col("b").alias("bi"), "vm"), ["panel", "i"]).join(beta.select("panel", F.col("asset").alias("j"), F.col("b").alias("bj")), ["panel", "j"])
    return _shrink(p.withColumn("target", F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(F.col("bi") * F.col("bj") * F.col("vm"))))


def shrink_oracle(panel: DataFrame) -> DataFrame:
    """Oracle approximating shrinkage towards the scaled identity."""
    s = sample(panel)
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    n = panel.groupBy("panel").agg(F.countDistinct("t").alias("t_n"))
    sums = s.groupBy("panel").agg(F.sum(twice * F.col("value") * F.col("value")).alias("s2"), F.sum(F.when(F.col("i") == F.col("j"), F.col("value")).otherwise(0.0)).alias("tr"), F.count_if(F.col("i") == F.col("j")).cast("double").alias("p")).join(n, "panel")
    top = (1 - F.lit(2.0) / F.col("p")) * F.col("s2") + F.col("tr") * F.col("tr")
    low = (F.col("t_n") + 1 - F.lit(2.0) / F.col("p")) * (F.col("s2") - F.col("tr") * F.col("tr") / F.col("p"))
    rho = F.when(low <= 1e-28, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(top, low), F.lit(1.0)))))
    d = sums.select("panel", rho.alias("delta"), (F.col("tr") / F.col("p")).alias("mu"))
    target = F.when(F.col("i") == F.col("j"), F.col("mu")).otherwise(0.0)
    return s.join(d, "panel").select(*PAIR, (F.col("delta") * target + (1 - F.col("delta")) * F.col("value")).alias("value"), "delta")


PLANS = {"sample": sample, "ewma": ewma, "shrink_identity": shrink_identity, "shrink_constant_correlation": shrink_constant_correlation, "shrink_single_factor": shrink_single_factor, "shrink_oracle": shrink_oracle}
