"""Registered queries over the driver's tables, and the same results in SQL for DuckDB where SQL expresses them.

Floating-point sums run in different orders in the two engines, so both sides
round; scales are chosen so that values are of order one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance, normal
from ..operators import backtest, bootstrap, covariance, dense, interpolation, moments, qmc, random_streams, roots
from ..sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(c, k: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, k)


# --- distributions ------------------------------------------------------------------------------------------------

_X = "(c_acctbal / 3000.0::DOUBLE)"


@query("normal_pdf", f"SELECT c_custkey, round({normal.DENSITY} * exp(-0.5 * {_X} * {_X}), 9) AS pdf FROM customer")
def normal_pdf(spark, d):
    c = panels.read(spark, d, "customer")
    return c.select("c_custkey", _r(normal.pdf(F.col("c_acctbal") / 3000.0), 9).alias("pdf"))


@query("normal_cdf", f"SELECT c_custkey, round({normal.cdf_sql(_X)}, 9) AS cdf FROM customer")
def normal_cdf(spark, d):
    c = panels.read(spark, d, "customer")
    return c.select("c_custkey", _r(normal.cdf(F.col("c_acctbal") / 3000.0), 9).alias("cdf"))


def _inverse_sql(source: str, key: str, result: str) -> str:
    """``key`` and ``result`` of x, the normal quantile of p, for CTEs that end in a (key, p, ...)."""

    def horner(x: str, terms) -> str:
        out = f"({terms[0]!r}::DOUBLE)"
        for t in terms[1:]:
            out = f"({out} * {x} + ({t!r}::DOUBLE))"
        return out

    start = f"CASE WHEN t < {normal.SPLIT} THEN {horner('q', normal.TAIL_TOP)} / {horner('q', normal.TAIL_BOTTOM)} ELSE c * {horner('(c * c)', normal.CENTRE_TOP)} / {horner('(c * c)', normal.CENTRE_BOTTOM)} END"
    step = lambda n: f"SELECT *, x{n} - ({normal.cdf_sql(f'x{n}')} - side) / ({normal.DENSITY} * exp(-0.5 * x{n} * x{n})) AS x{n + 1} FROM s{n}"
    return f"""{source},
    b AS (SELECT *, least(p, 1 - p) AS t, p - 0.5 AS c, p > 1 - {normal.SPLIT} AS upper_, CASE WHEN p > 1 - {normal.SPLIT} THEN 1 - p ELSE p END AS side FROM a),
    b2 AS (SELECT *, sqrt(-2 * ln(t)) AS q FROM b), s0 AS (SELECT *, {start} AS x0 FROM b2), s1 AS ({step(0)}), s2 AS ({step(1)})
    SELECT {key}, {result} FROM (SELECT *, CASE WHEN upper_ THEN -x2 ELSE x2 END AS x FROM s2)"""


@query("normal_inverse", _inverse_sql("WITH a AS (SELECT c_custkey, (c_custkey % 997 + 1) / 998.0::DOUBLE AS p FROM customer)", "c_custkey", "round(x, 8) AS x"))
def normal_inverse(spark, d):
    c = panels.read(spark, d, "customer")
    p = (F.col("c_custkey") % 997 + 1) / F.lit(998.0)
    return c.select("c_custkey", _r(normal.inverse(p), 8).alias("x"))


# --- moments and correlation --------------------------------------------------------------------------------------


@query(
    "moments",
    """SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(coalesce(var_samp(l_quantity), 0), 5) AS variance, round(var_pop(l_quantity), 5) AS variance_pop,
    round(coalesce(stddev_samp(l_quantity), 0), 6) AS sd, round(skewness(l_quantity), 6) AS skewness, round(kurtosis(l_quantity), 6) AS kurtosis FROM lineitem GROUP BY 1""",
)
def moments_query(spark, d):
    li = panels.read(spark, d, "lineitem")
    n, mean, var, pop, sd = moments.welford("l_quantity")
    return li.groupBy("l_returnflag").agg(
        n.alias("n"), _r(mean).alias("mean"), _r(var, 5).alias("variance"), _r(pop, 5).alias("variance_pop"), _r(sd).alias("sd"),
        _r(moments.sample_skewness("l_quantity")).alias("skewness"), _r(moments.sample_kurtosis("l_quantity")).alias("kurtosis"),
    )


@query("moments_merged", "SELECT l_returnflag, count(l_quantity)::BIGINT AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 4) AS variance FROM lineitem GROUP BY 1")
def moments_merged(spark, d):
    li = panels.read(spark, d, "lineitem").groupBy("l_returnflag", F.date_trunc("month", "l_shipdate").alias("m")).agg(moments.moment_state("l_quantity").alias("s"))
    return moments.merged(li, "s", ["l_returnflag"]).select("l_returnflag", F.col("count").alias("n"), _r(F.col("mean")).alias("mean"), _r(F.col("variance"), 4).alias("variance"))


_PEARSON = "CASE WHEN count(*) >= 3 AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) ELSE 0 END"


@query("pearson", f"SELECT l_returnflag, l_linestatus, round({_PEARSON.format(x='l_quantity', y='l_extendedprice')}, 6) AS pearson, round(covar_samp(l_quantity, l_extendedprice / 1000), 4) AS covariance FROM lineitem GROUP BY 1, 2")
def pearson(spark, d):
    li = panels.read(spark, d, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(_r(moments.pearson("l_quantity", "l_extendedprice")).alias("pearson"), _r(moments.covariance(F.col("l_quantity"), F.col("l_extendedprice") / 1000), 4).alias("covariance"))


_PAIRS_SQL = f"WITH {panels.SEGMENT_MONTHS_SQL}, p AS (SELECT a.t, a.asset AS i, b.asset AS j, a.value AS x, b.value AS y FROM r a JOIN r b ON a.t = b.t AND a.asset < b.asset)"


def _pairs(spark, d) -> DataFrame:
    r = panels.segment_months(spark, d)
    a = r.select("t", F.col("asset").alias("i"), F.col("value").alias("x"))
    b = r.select(F.col("t").alias("t2"), F.col("asset").alias("j"), F.col("value").alias("y"))
    return a.join(b, (F.col("t") == F.col("t2")) & (F.col("i") < F.col("j"))).select("i", "j", "t", "x", "y")


@query(
    "rolling_pearson",
    _PAIRS_SQL
    + """, w AS (SELECT i, j, t, row_number() OVER (PARTITION BY i, j ORDER BY t) AS k, covar_pop(x, y) OVER v AS c, var_pop(x) OVER v AS vx, var_pop(y) OVER v AS vy FROM p
    WINDOW v AS (PARTITION BY i, j ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
    SELECT i, j, t, round(CASE WHEN vx > 0 AND vy > 0 THEN c / sqrt(vx * vy) ELSE 0 END, 6) AS pearson FROM w WHERE k >= 12""",
)
def rolling_pearson(spark, d):
    return moments.rolling_pearson(_pairs(spark, d), "x", "y", 12, ["i", "j"], ["t"]).select("i", "j", "t", _r("pearson").alias("pearson"))


@query("pearson_slice", _PAIRS_SQL + f" SELECT i, j, round({_PEARSON.format(x='x', y='y')}, 6) AS pearson FROM p WHERE t >= TIMESTAMP '1994-01-01' AND t < TIMESTAMP '1996-01-01' GROUP BY i, j")
def pearson_slice(spark, d):
    p = _pairs(spark, d).filter("t >= timestamp '1994-01-01' and t < timestamp '1996-01-01'")
    return p.groupBy("i", "j").agg(_r(moments.pearson("x", "y")).alias("pearson"))


@query(
    "spearman",
    """WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS ry FROM lineitem)
    SELECT l_returnflag, round(covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)), 6) AS spearman FROM k GROUP BY 1""",
)
def spearman(spark, d):
    li = panels.read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "f")
    return moments.spearman(li, "l_quantity", "l_discount", ["f"]).select(F.col("f").alias("l_returnflag"), _r("spearman").alias("spearman"))


@query(
    "kendall",
    _PAIRS_SQL
    + """, s AS (SELECT a.i, a.j, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, sum((a.x = b.x)::INT) AS tx, sum((a.y = b.y)::INT) AS ty, count(*)::DOUBLE AS n
    FROM p a JOIN p b ON a.i = b.i AND a.j = b.j AND a.t < b.t GROUP BY a.i, a.j) SELECT i, j, round(s / sqrt((n - tx) * (n - ty)), 8) AS kendall FROM s""",
)
def kendall(spark, d):
    return moments.kendall(_pairs(spark, d), "x", "y", ["i", "j"]).select("i", "j", _r("kendall", 8).alias("kendall"))


@query(
    "distance_correlation",
    _PAIRS_SQL
    + """, q AS (SELECT a.i, a.j, a.t AS t1, b.t AS t2, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b FROM p a JOIN p b ON a.i = b.i AND a.j = b.j),
    c AS (SELECT i, j, a - avg(a) OVER (PARTITION BY i, j, t1) - avg(a) OVER (PARTITION BY i, j, t2) + avg(a) OVER (PARTITION BY i, j) AS a,
      b - avg(b) OVER (PARTITION BY i, j, t1) - avg(b) OVER (PARTITION BY i, j, t2) + avg(b) OVER (PARTITION BY i, j) AS b FROM q)
    SELECT i, j, round(sqrt(avg(a * b) / sqrt(avg(a * a) * avg(b * b))), 6) AS distance_correlation FROM c GROUP BY i, j""",
)
def distance_correlation(spark, d):
    return moments.distance_correlation(_pairs(spark, d), "x", "y", ["i", "j"]).select("i", "j", _r("distance_correlation").alias("distance_correlation"))


@query(
    "fisher_z",
    _PAIRS_SQL
    + f""", c AS (SELECT i, j, count(*) AS n, {_PEARSON.format(x='x', y='y')} AS r FROM p GROUP BY i, j), z AS (SELECT *, 0.5 * ln((1 + r) / (1 - r)) AS z, 1.959963984540054 / sqrt(n - 3) AS w FROM c)
    SELECT i, j, round(z, 6) AS z, round(tanh(z), 6) AS back, round(tanh(z - w), 6) AS low, round(tanh(z + w), 6) AS high FROM z""",
)
def fisher_z(spark, d):
    c = _pairs(spark, d).groupBy("i", "j").agg(F.count("x").alias("n"), moments.pearson("x", "y").alias("r"))
    ci = finance.fisher_interval(F.col("r"), F.col("n"))
    z = finance.fisher_z(F.col("r"))
    return c.select("i", "j", _r(z).alias("z"), _r(finance.fisher_inverse(z)).alias("back"), _r(ci["low"]).alias("low"), _r(ci["high"]).alias("high"))


@query("percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def percentiles(spark, d):
    li = panels.read(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(*(_r(moments.percentile("l_extendedprice", p), 4).alias(n) for n, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))))


@query("simple_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def simple_regression(spark, d):
    li = panels.read(spark, d, "lineitem")
    slope, intercept, r2 = moments.simple_regression("l_extendedprice", "l_quantity")
    return li.groupBy("l_returnflag").agg(_r(slope, 4).alias("slope"), _r(intercept, 3).alias("intercept"), _r(r2).alias("r2"))


@query(
    "rolling_window",
    f"WITH {panels.SEGMENT_MONTHS_SQL} SELECT asset, t, len(list(value) OVER w) AS n, round((list(value) OVER w)[1], 6) AS oldest, round(value, 6) AS newest FROM r WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
)
def rolling_window(spark, d):
    r = moments.rolling_window(panels.segment_months(spark, d), "value", 6, ["asset"], ["t"])
    return r.select("asset", "t", F.size("window").cast("long").alias("n"), _r(F.get("window", F.lit(0))).alias("oldest"), _r(F.element_at("window", -1)).alias("newest"))


# --- backtest and time series -------------------------------------------------------------------------------------


@query(
    "newey_west",
    f"""WITH {panels.SEGMENT_MONTHS_SQL}, z AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY t) AS k, count(*) OVER (PARTITION BY asset) AS n, value - avg(value) OVER (PARTITION BY asset) AS z FROM r),
    l AS (SELECT *, greatest(1, floor(4 * pow(n / 100.0, 2.0 / 9)))::INT AS lags FROM z)
    SELECT a.asset, any_value(a.n)::BIGINT AS n, any_value(a.lags)::INT AS lags, round(sum(CASE WHEN a.k = b.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / (a.lags + 1)) END * a.z * b.z) / any_value(a.n) / any_value(a.n) * 1e4, 6) AS variance
    FROM l a JOIN l b ON a.asset = b.asset AND a.k - b.k BETWEEN 0 AND a.lags GROUP BY a.asset""",
)
def newey_west(spark, d):
    nw = backtest.newey_west(panels.segment_months(spark, d), "value", ["asset"], ["t"])
    return nw.select("asset", "n", "lags", _r(F.col("variance") * 1e4).alias("variance"))


@query(
    "generalization_score",
    f"""WITH {panels.SEGMENT_MONTHS_SQL}, k AS (SELECT asset, value / 10 AS r, row_number() OVER (PARTITION BY asset ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY asset) AS n FROM r),
    w AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY asset ORDER BY k)) AS wealth FROM k),
    p AS (SELECT *, greatest(1.0, max(wealth) OVER (PARTITION BY asset ORDER BY k)) AS peak FROM w),
    dd AS (SELECT asset, max((peak - wealth) / peak) AS dd, avg(r) AS m, stddev_samp(r) AS sd, count(*) AS n FROM p GROUP BY asset),
    per AS (SELECT asset, least(k // greatest(n // 12, 1), 11) AS p, sum(r) AS s FROM k GROUP BY ALL),
    c AS (SELECT asset, avg((s > 0)::INT) AS share FROM per GROUP BY asset)
    SELECT asset, round(0.3 * m / sd * sqrt(252) + 0.3 * greatest(0, m / (sd / sqrt(n))) / sqrt(n) * sqrt(252) + 0.2 * share - 0.2 * dd, 6) AS score, round(0.2 * share, 6) AS consistency, round(0.2 * dd, 6) AS downside FROM dd JOIN c USING (asset)""",
)
def generalization_score(spark, d):
    r = panels.segment_months(spark, d).withColumn("value", F.col("value") / 10)
    g = backtest.generalization_score(r, "value", ["asset"], ["t"])
    return g.select("asset", _r("score").alias("score"), _r("consistency").alias("consistency"), _r("downside").alias("downside"))


_SHARPES = f"""WITH {panels.SEGMENT_MONTHS_SQL}, m AS (SELECT asset, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM r GROUP BY asset),
z AS (SELECT asset, any_value(n) AS n, any_value(m / sd) * sqrt(12) AS sharpe, avg(pow((value - m) / sd, 3)) AS skew, avg(pow((value - m) / sd, 4)) AS kurt FROM r JOIN m USING (asset) GROUP BY asset)"""


@query(
    "deflated_sharpe",
    _SHARPES
    + f""", e AS (SELECT *, sqrt(2 * ln(100)) * (1 - {finance.EULER} / ln(100)) + {finance.EULER} / sqrt(2 * ln(100)) AS best, 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe AS raw FROM z),
    f AS (SELECT *, (sharpe - best) / sqrt(CASE WHEN raw < 0 THEN 1 ELSE raw END / n) AS t FROM e)
    SELECT asset, round(sharpe, 6) AS sharpe, round(best, 6) AS expected_max, round(sharpe - best, 6) AS deflated, round(1 - {normal.cdf_sql('t')}, 6) AS p_value FROM f""",
)
def deflated_sharpe(spark, d):
    g = backtest.deflated_sharpe_returns(panels.segment_months(spark, d), "value", ["asset"], trials=100, days=12)
    return g.select("asset", *(_r(c).alias(c) for c in ("sharpe", "expected_max", "deflated", "p_value")))


def _sharpes(spark, d) -> DataFrame:
    x = F.col("value")
    m = panels.segment_months(spark, d).groupBy("asset").agg(F.count(x).alias("n"), (F.avg(x) / F.stddev_pop(x) * F.sqrt(F.lit(12.0))).alias("sharpe"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))
    return m


@query(
    "haircut_sharpe",
    _SHARPES
    + f""", p AS (SELECT *, 1 - {normal.cdf_sql('abs(sharpe) * sqrt(n)')} AS p FROM z)
    SELECT asset, round(p, 7) AS p_value, round(least(1, 10 * p), 7) AS bonferroni, round(least(1, 10 * p), 7) AS holm, round(least(1, p * (SELECT sum(1.0 / k) FROM range(1, 11) t(k))), 7) AS bhy FROM p""",
)
def haircut_sharpe(spark, d):
    g = _sharpes(spark, d).select("asset", finance.haircut_sharpe(F.abs("sharpe"), F.lit(10), F.col("n") / 12.0, 12).alias("h"))
    return g.select("asset", *(_r(f"h.{c}", 7).alias(c) for c in ("p_value", "bonferroni", "holm", "bhy")))


@query(
    "haircut_sharpe_ratio",
    _inverse_sql(
        _SHARPES
        + f""", h AS (SELECT *, least(1, (1 - {normal.cdf_sql('sharpe * sqrt(n)')}) * (SELECT sum(1.0 / k) FROM range(1, 11) t(k))) AS bhy FROM z),
    a AS (SELECT asset, sharpe, n, least(greatest(1 - bhy, 1e-15), 1 - 1e-15)::DOUBLE AS p FROM h)""",
        "asset",
        "round(least(x / sqrt(n), sharpe), 6) AS haircut",
    ),
)
def haircut_sharpe_ratio(spark, d):
    g = _sharpes(spark, d).select("asset", finance.haircut_sharpe(F.col("sharpe"), F.lit(10), F.col("n") / 12.0, 12).alias("h"))
    return g.select("asset", _r("h.haircut").alias("haircut"))


@query(
    "minimum_track_record",
    _SHARPES
    + """, g AS (SELECT *, 1 - skew * abs(sharpe) + (kurt - 1) / 4 * sharpe * sharpe AS raw FROM z)
    SELECT asset, round((1 + CASE WHEN raw < 0 THEN 1 ELSE raw END * pow(1.6448536269514722, 2) / pow(abs(sharpe) + 1, 2)) / 12, 6) AS years FROM g""",
)
def minimum_track_record(spark, d):
    y = finance.minimum_track_record(F.abs("sharpe"), F.lit(-1.0), F.col("skew"), F.col("kurt"), days=12)
    return _sharpes(spark, d).select("asset", _r(y).alias("years"))


@query(
    "backtest_overfitting",
    f"""WITH {panels.EVENT_HOURS_SQL}, k AS (SELECT asset, value - 50 AS r, row_number() OVER (PARTITION BY asset ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY asset) AS n FROM h),
    c AS (SELECT asset, r, k // (n // 6) AS b FROM k WHERE k < n // 6 * 6),
    s AS (SELECT asset, b, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) ELSE 0 END AS v FROM c GROUP BY ALL),
    m AS (SELECT x AS mask FROM range(64) t(x) WHERE bit_count(x::INT) = 3),
    e AS (SELECT mask, asset, sum(CASE WHEN (mask >> b::INT) & 1 = 1 THEN v ELSE 0 END) / 3 AS inner_, sum(CASE WHEN (mask >> b::INT) & 1 = 0 THEN v ELSE 0 END) / 3 AS outer_ FROM s, m GROUP BY ALL),
    w AS (SELECT mask, first(asset ORDER BY inner_ DESC, asset) AS best, count(*) AS n FROM e GROUP BY mask),
    o AS (SELECT mask, best, n, outer_ AS mine FROM w JOIN e USING (mask) WHERE asset = best),
    q AS (SELECT o.mask, o.n, sum((e.outer_ < mine OR (e.outer_ = mine AND e.asset < best))::INT) + 1 AS rank_ FROM o JOIN e USING (mask) GROUP BY ALL),
    l AS (SELECT ln((rank_ / (n + 1)) / (1 - rank_ / (n + 1))) AS logit FROM q)
    SELECT round(avg((logit <= 0)::INT), 6) AS pbo, round(list_sort(list(logit))[count(*) // 2 + 1], 6) AS median_logit, count(*) AS combinations FROM l""",
)
def backtest_overfitting(spark, d):
    h = backtest.numbered(panels.event_hours(spark, d), ["asset"], ["t"])
    h = h.filter(F.col("k") < F.floor(F.col("n") / 6) * 6).withColumn("r", F.col("value") - 50)
    p = backtest.overfitting(h, "asset", "t", "r", splits=6)
    return p.select(_r("pbo").alias("pbo"), _r("median_logit").alias("median_logit"), "combinations")


# --- covariance ---------------------------------------------------------------------------------------------------

_COV = f"""WITH {panels.SEGMENT_MONTHS_SQL}, z AS (SELECT t, asset, value - avg(value) OVER (PARTITION BY asset) AS z FROM r),
q AS (SELECT a.t, a.asset AS i, b.asset AS j, a.z AS zi, b.z AS zj FROM z a JOIN z b ON a.t = b.t AND a.asset <= b.asset),
s AS (SELECT i, j, sum(zi * zj) / (count(*) - 1) AS s FROM q GROUP BY i, j),
pi AS (SELECT i, j, any_value(s) AS s, avg(pow(zi * zj - s, 2)) AS pi, count(*) AS n FROM q JOIN s USING (i, j) GROUP BY i, j)"""
_DELTA = """, d AS (SELECT *, CASE WHEN i = j THEN 1 ELSE 2 END AS w FROM f),
e AS (SELECT greatest(0, least(1, {top} / (any_value(n) * sum(w * pow(s - target, 2))))) AS delta FROM d)
SELECT i, j, round((delta * target + (1 - delta) * s) * 100, 6) AS value, round(delta, 6) AS delta FROM d, e"""


def _cov(name: str, plan) -> Query:
    def run(spark, d):
        out = plan(panels.segment_months(spark, d))
        return out.select("i", "j", _r(F.col("value") * 100).alias("value"), *([_r("delta").alias("delta")] if "delta" in out.columns else []))

    return run


query("covariance_sample", _COV + " SELECT i, j, round(s * 100, 6) AS value FROM s")(_cov("sample", covariance.sample))
query(
    "covariance_ewma",
    f"""WITH {panels.SEGMENT_MONTHS_SQL}, z AS (SELECT t, asset, value - avg(value) OVER (PARTITION BY asset) AS z, pow(0.94, row_number() OVER (PARTITION BY asset ORDER BY t DESC) - 1) AS w FROM r)
    SELECT a.asset AS i, b.asset AS j, round(sum(a.w * a.z * b.z) / sum(a.w) * 100, 6) AS value FROM z a JOIN z b ON a.t = b.t AND a.asset <= b.asset GROUP BY 1, 2""",
)(_cov("ewma", covariance.ewma))
query(
    "covariance_shrink_identity",
    _COV + ", f AS (SELECT *, CASE WHEN i = j THEN (SELECT avg(s) FROM s WHERE i = j) ELSE 0 END AS target FROM pi)" + _DELTA.format(top="(sum(w * pi) - sum(CASE WHEN i = j THEN pi ELSE 0 END))"),
)(_cov("identity", covariance.shrink_identity))
query(
    "covariance_shrink_correlation",
    _COV
    + """, sd AS (SELECT i AS k, sqrt(s) AS sd FROM s WHERE i = j), c AS (SELECT pi.*, a.sd AS si, b.sd AS sj FROM pi JOIN sd a ON i = a.k JOIN sd b ON j = b.k),
    f AS (SELECT *, CASE WHEN i = j THEN s ELSE (SELECT avg(s / (si * sj)) FROM c WHERE i <> j) * si * sj END AS target FROM c)"""
    + _DELTA.format(top="sum(w * pi)"),
)(_cov("correlation", covariance.shrink_constant_correlation))
query(
    "covariance_shrink_factor",
    _COV
    + """, m AS (SELECT t, avg(z) AS m FROM z GROUP BY t), vm AS (SELECT sum(m * m) / (count(*) - 1) AS vm FROM m),
    b AS (SELECT asset, sum(z * m) / (count(*) - 1) / any_value(vm) AS b FROM z JOIN m USING (t), vm GROUP BY asset),
    f AS (SELECT pi.*, CASE WHEN i = j THEN s ELSE x.b * y.b * vm END AS target FROM pi JOIN b x ON i = x.asset JOIN b y ON j = y.asset, vm)"""
    + _DELTA.format(top="sum(w * pi)"),
)(_cov("factor", covariance.shrink_single_factor))
query(
    "covariance_shrink_oracle",
    _COV
    + """, k AS (SELECT sum(CASE WHEN i = j THEN 1 ELSE 2 END * s * s) AS s2, sum(CASE WHEN i = j THEN s ELSE 0 END) AS tr, sum((i = j)::INT)::DOUBLE AS p, (SELECT any_value(n) FROM pi) AS n FROM s),
    e AS (SELECT tr / p AS mu, greatest(0, least(1, ((1 - 2 / p) * s2 + tr * tr) / ((n + 1 - 2 / p) * (s2 - tr * tr / p)))) AS delta FROM k)
    SELECT i, j, round((delta * CASE WHEN i = j THEN mu ELSE 0 END + (1 - delta) * s) * 100, 6) AS value, round(delta, 6) AS delta FROM s, e""",
)(_cov("oracle", covariance.shrink_oracle))

for _kind in ("denoised", "detoned", "tracy_widom", "doubly_sparse", "quadratic_inverse", "nercome", "poet"):
    query(f"covariance_{_kind}")(lambda spark, d, kind=_kind: dense.spectral_covariance(panels.segment_months(spark, d), kind))
query("covariance_denoised_embeddings")(lambda spark, d: dense.spectral_covariance(panels.embedding_panel(spark, d), "denoised", shrink=True))


# --- interpolation ------------------------------------------------------------------------------------------------


def _curves(spark, d) -> tuple[DataFrame, DataFrame]:
    """Cumulative value by customer nation over months as curves, and queries at every order's day."""
    o = panels.read(spark, d, "orders").join(panels.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double")
    knots = o.groupBy(F.col("c_nationkey").alias("curve"), (F.floor(day / 90) * 90.0).alias("x")).agg((F.sum("o_totalprice") / 3e5 + 1).alias("y"))
    queries = o.select(F.col("c_nationkey").alias("curve"), F.col("o_orderkey"), (day + 0.25).alias("q"))
    return knots, queries


_CURVES_SQL = """o AS (SELECT c_nationkey AS curve, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day_, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
k AS (SELECT curve, floor(day_ / 90) * 90.0 AS x, sum(o_totalprice) / 3e5 + 1 AS y FROM o GROUP BY 1, 2),
sg AS (SELECT curve, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY curve ORDER BY x)),
q AS (SELECT curve, o_orderkey, day_ + 0.25 AS q FROM o),
a AS (SELECT q.*, coalesce(sg.x, f.x) AS x, coalesce(sg.y, f.y) AS y, sg.x1, sg.y1, sg.x IS NULL AS before_ FROM q ASOF LEFT JOIN sg ON q.curve = sg.curve AND q.q >= sg.x LEFT JOIN (SELECT * FROM sg WHERE n = 1) f ON q.curve = f.curve)"""


def _curve_query(kind: str, **options) -> Query:
    def run(spark, d):
        knots, queries = _curves(spark, d)
        return interpolation.interpolate(knots, queries, kind, **options).select("o_orderkey", _r("value").alias("value"))

    return run


query("interpolate_linear", f"WITH {_CURVES_SQL} SELECT o_orderkey, round(CASE WHEN before_ OR x1 IS NULL THEN y ELSE y + (q - x) * ((y1 - y) / (x1 - x)) END, 6) AS value FROM a")(_curve_query("linear"))
for _kind in ("log_linear", "flat_forward"):
    query(f"interpolate_{_kind}", f"WITH {_CURVES_SQL} SELECT o_orderkey, round(CASE WHEN before_ OR x1 IS NULL THEN y ELSE exp(ln(y) + (q - x) * ((ln(y1) - ln(y)) / (x1 - x))) END, 6) AS value FROM a")(_curve_query(_kind))
query("interpolate_monotone_cubic")(_curve_query("monotone_cubic"))
for _kind in ("natural", "not_a_knot", "modified_not_a_knot", "qspline", "clamped"):
    query(f"interpolate_cubic_{_kind}")(_curve_query("cubic", boundary=_kind))


@query(
    "interpolate_monotone_convex",
    """WITH o AS (SELECT c_nationkey AS curve, o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS day_, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey),
    k0 AS (SELECT curve, floor(day_ / 90) * 90.0 AS x, sum(o_totalprice) / 1e6 AS v FROM o GROUP BY 1, 2), k AS (SELECT curve, x, sum(v) OVER (PARTITION BY curve ORDER BY x) AS y FROM k0),
    s AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS f FROM k WINDOW w AS (PARTITION BY curve ORDER BY x)),
    g0 AS (SELECT *, lag(f) OVER w AS f0, (lag(h) OVER w * f + h * lag(f) OVER w) / (lag(h) OVER w + h) AS raw FROM s WINDOW w AS (PARTITION BY curve ORDER BY x)),
    g1 AS (SELECT *, coalesce((3 * f - lead(raw) OVER w) / 2, f) AS first_, coalesce((3 * f0 - lag(raw) OVER w) / 2, f0) AS last_ FROM g0 WINDOW w AS (PARTITION BY curve ORDER BY x)),
    g2 AS (SELECT *, CASE WHEN f0 IS NOT NULL AND f IS NOT NULL THEN CASE WHEN least(f0, f) > 0 THEN greatest(0, least(raw, 2 * least(f0, f))) ELSE 0 END
      WHEN f0 IS NULL THEN greatest(0, least(first_, 2 * f)) ELSE greatest(0, least(last_, 2 * f0)) END AS g FROM g1),
    g3 AS (SELECT *, lead(g) OVER (PARTITION BY curve ORDER BY x) AS g1_ FROM g2),
    q AS (SELECT curve, o_orderkey, day_ + 0.25 AS q FROM o), a AS (SELECT q.q, q.o_orderkey, g3.* FROM q ASOF JOIN g3 ON q.curve = g3.curve AND q.q >= g3.x)
    SELECT o_orderkey, round(CASE WHEN h IS NULL THEN y ELSE y + h * (f * u + (g - f) * (u - 2 * u * u + u * u * u) + (g1_ - f) * (u * u * u - u * u)) END, 6) AS value FROM (SELECT *, (q - x) / h AS u FROM a)""",
)
def interpolate_monotone_convex(spark, d):
    from pyspark.sql import Window as W

    o = panels.read(spark, d, "orders").join(panels.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double")
    k = o.groupBy(F.col("c_nationkey").alias("curve"), (F.floor(day / 90) * 90.0).alias("x")).agg((F.sum("o_totalprice") / 1e6).alias("v"))
    knots = k.select("curve", "x", F.sum("v").over(W.partitionBy("curve").orderBy("x")).alias("y"))
    queries = o.select(F.col("c_nationkey").alias("curve"), F.col("o_orderkey"), (day + 0.25).alias("q"))
    return interpolation.interpolate(knots, queries, "monotone_convex").select("o_orderkey", _r("value").alias("value"))


@query("interpolate_two_point", "SELECT p_partkey, round(10 + (p_retailprice - 900) / (p_size + 100 - 1) * (p_size - 10), 6) AS value FROM part")
def interpolate_two_point(spark, d):
    p = panels.read(spark, d, "part")
    v = finance.two_point(F.col("p_retailprice"), F.lit(900.0), F.lit(10.0), F.lit(899.0) + F.col("p_size") + 100, F.col("p_size").cast("double"))
    return p.select("p_partkey", _r(v).alias("value"))


# --- linear algebra, solvers --------------------------------------------------------------------------------------


def _cov_matrix(spark, d) -> DataFrame:
    return covariance.sample(panels.segment_months(spark, d))


def _factor_sql(n: int = 5) -> str:
    """CTEs up to l: the lower factor of the covariance of n assets, entry by entry, pivots d and the solution x for its diagonal."""
    num = range(1, n + 1)
    cells = [f"max(CASE WHEN a.k = {i} AND b.k = {j} THEN s END) AS s{i}{j}" for i in num for j in num if i <= j]
    terms = []
    for j in num:
        terms.append(f"s{j}{j}{''.join(f' - l{j}{k} * l{j}{k}' for k in range(1, j))} AS d{j}, sqrt(d{j}) AS l{j}{j}")
        terms += [f"(s{j}{i}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(1, j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, n + 1)]
    terms += [f"(s{i}{i}{''.join(f' - l{i}{k} * y{k}' for k in range(1, i))}) / l{i}{i} AS y{i}" for i in num]
    terms += [f"(y{i}{''.join(f' - l{k}{i} * x{k}' for k in range(i + 1, n + 1))}) / l{i}{i} AS x{i}" for i in reversed(num)]
    return f"""{_COV}, ix AS (SELECT asset, row_number() OVER (ORDER BY asset) AS k FROM (SELECT DISTINCT asset FROM r)),
    m AS (SELECT {", ".join(cells)} FROM s JOIN ix a ON s.i = a.asset JOIN ix b ON s.j = b.asset), l AS (SELECT *, {", ".join(terms)} FROM m)"""


_ENTRIES = ", ".join(f"{{'k': {i}, 'q': {j}, 'v': {f'l{i}{j}' if j <= i else '0.0::DOUBLE'}}}" for i in range(1, 6) for j in range(1, 6))
_SOLVED = f"{_factor_sql()}, u AS (SELECT unnest([{', '.join(f'{{{chr(39)}k{chr(39)}: {i}, {chr(39)}v{chr(39)}: x{i}}}' for i in range(1, 6))}], recursive := true) FROM l) SELECT 'segment' AS panel, asset AS i, round(v, 6) AS value FROM u JOIN ix USING (k)"
query("cholesky", f"{_factor_sql()}, u AS (SELECT unnest([{_ENTRIES}], recursive := true) FROM l) SELECT a.asset AS i, b.asset AS j, round(v, 8) AS value FROM u JOIN ix a ON u.k = a.k JOIN ix b ON u.q = b.k")(lambda spark, d: dense.cholesky(_cov_matrix(spark, d)).select("i", "j", _r("value", 8).alias("value")))
query("cholesky_pivoted")(lambda spark, d: dense.pivoted_cholesky(_cov_matrix(spark, d)))
query("eigen")(lambda spark, d: dense.eigen(_cov_matrix(spark, d)).select("panel", "k", _r("eigenvalue", 8).alias("eigenvalue")))
query("nearest_psd")(lambda spark, d: dense.eigen_clip(_cov_matrix(spark, d), 1e-4))
query("nearest_correlation")(lambda spark, d: dense.higham(_cov_matrix(spark, d)))
query("is_psd", f"{_factor_sql()} SELECT 'segment' AS panel, least(d1, d2, d3, d4, d5) >= 0 AS psd FROM l")(lambda spark, d: dense.is_psd(_cov_matrix(spark, d)))
query("pca_covariance")(lambda spark, d: dense.pca_covariance(dense.map_matrix(_cov_matrix(spark, d), lambda a: (a + a.T) / 2)))
query("pca_returns")(lambda spark, d: dense.pca_returns(panels.embedding_panel(spark, d), standardize=True))
query("pca_components_needed")(lambda spark, d: dense.components_needed(dense.pca_returns(panels.embedding_panel(spark, d)), 0.9))


@query("pca_scores")
def pca_scores(spark, d):
    r = panels.segment_months(spark, d)
    return dense.project(r, dense.pca_returns(r), 2)


def _system(spark, d) -> tuple[DataFrame, DataFrame]:
    m = _cov_matrix(spark, d)
    return m, m.filter("i = j").select("panel", "i", "value")


query("solve_gaussian", _SOLVED)(lambda spark, d: dense.solve(*_system(spark, d)).withColumn("value", _r("value")))
query("solve_cholesky", _SOLVED)(lambda spark, d: dense.solve(*_system(spark, d), method="cholesky").withColumn("value", _r("value")))
query("portfolio_min_variance")(lambda spark, d: dense.min_variance(_cov_matrix(spark, d), 0.05, 0.5))


@query("portfolio_mean_variance")
def portfolio_mean_variance(spark, d):
    means = panels.segment_months(spark, d).groupBy("panel", "asset").agg(F.avg("value").alias("value"))
    return dense.mean_variance(_cov_matrix(spark, d), means, 3.0, 0.0, 0.6)


@query("portfolio_greedy")
def portfolio_greedy(spark, d):
    means = panels.segment_months(spark, d).groupBy("panel", "asset").agg(F.avg("value").alias("value"))
    return dense.mean_variance(_cov_matrix(spark, d), means, 0.0, 0.05, 0.6)


@query("ols")
def ols(spark, d):
    li = panels.read(spark, d, "lineitem")
    return dense.ols(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])


@query(
    "ols_normal",
    """WITH z AS (SELECT l_returnflag, l_extendedprice - avg(l_extendedprice) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS a, l_discount - avg(l_discount) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)),
    s AS (SELECT l_returnflag, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS "by", sum(y * y) AS yy, count(*) AS n FROM z GROUP BY 1),
    c AS (SELECT *, (bb * ay - ab * "by") / (aa * bb - ab * ab) AS b1, (aa * "by" - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s)
    SELECT l_returnflag, round(b1, 4) AS slope_quantity, round(b2 / 1000, 4) AS slope_discount, n - 3 AS dof, round((b1 * ay + b2 * "by") / yy, 6) AS r_squared FROM c""",
)
def ols_normal(spark, d):
    got = dense.ols_normal(panels.read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ["l_returnflag"])
    return got.select("l_returnflag", _r(F.get("coefficients", F.lit(1)), 4).alias("slope_quantity"), _r(F.get("coefficients", F.lit(2)) / 1000, 4).alias("slope_discount"), "dof", _r("r_squared").alias("r_squared"))


@query("levenberg_marquardt")
def levenberg_marquardt(spark, d):
    """Exponential trend of monthly order value by market segment."""
    o = panels.read(spark, d, "orders").join(panels.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = F.months_between(F.date_trunc("month", "o_orderdate"), F.lit("1992-01-01")).cast("double") / 12
    rows = o.groupBy("c_mktsegment", m.alias("m")).agg((F.avg("o_totalprice") / 1e5).alias("v"))
    return dense.least_squares(rows, "m", "v", lambda p, t: p[0] * np.exp(-p[1] * t), [1.0, 0.01], ["c_mktsegment"])


def _yield(x, rows):
    """Internal rate: twelve equal payments of a part's price."""
    n = np.arange(1, 13)[:, None]
    return (rows["payment"].to_numpy() * (1 + x) ** -n).sum(axis=0) - rows["p_retailprice"].to_numpy()


#: Sixty halvings of the bracket, whatever the method.
_ROOTS = """WITH RECURSIVE p AS (SELECT p_partkey, p_retailprice::DOUBLE AS price, p_retailprice / 12 * (1 + p_size / 100.0::DOUBLE) AS pay FROM part),
b AS (SELECT p_partkey, price, pay, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, 0 AS k FROM p UNION ALL
  SELECT p_partkey, price, pay, CASE WHEN f > 0 THEN mid ELSE low END, CASE WHEN f > 0 THEN high ELSE mid END, k + 1
  FROM (SELECT *, (low + high) / 2 AS mid, pay * (1 - pow(1 + (low + high) / 2, -12)) / ((low + high) / 2) - price AS f FROM b WHERE k < 60))
SELECT p_partkey, round((low + high) / 2, 5) AS root, true AS converged FROM b WHERE k = 60"""


for _method in (*roots.BRACKETED, *roots.OPEN):

    @query(f"root_{_method}", _ROOTS)
    def _root(spark, d, method=_method):
        p = panels.read(spark, d, "part").select("p_partkey", "p_retailprice", (F.col("p_retailprice") / 12 * (1 + F.col("p_size") / 100.0)).alias("payment"))
        p = p.withColumn("lower", F.lit(0.0)).withColumn("upper", F.lit(1.0)).withColumn("guess", F.lit(0.02))
        options = {"delta": 0.01} if method == "muller" else {}
        tol = {"f_tol": 1e-9} if method == "bisection" else {"tol": 1e-9}
        got = roots.solve(p, _yield, method, **tol, **options)
        return got.select("p_partkey", _r("root", 5).alias("root"), "converged")


# --- bootstrap, quasi-random sequences ----------------------------------------------------------------------------


def _months(spark, d) -> DataFrame:
    return bootstrap.series(panels.segment_months(spark, d), "asset", ["t"], "value")


def _mean_boot(kind: str, block: float) -> Query:
    return lambda spark, d: bootstrap.monte_carlo(_months(spark, d), F.avg("value"), 500, kind, block, seed=11)


for _kind, _block in (("iid", 1), ("circular", 6), ("moving", 6), ("stationary", 6.0)):
    query(f"bootstrap_{_kind}")(_mean_boot(_kind, _block))
query("bootstrap_multi")(lambda spark, d: bootstrap.monte_carlo_multi(_months(spark, d), [F.avg("value"), F.stddev_samp("value"), F.max("value")], ["mean", "sd", "max"], 500, seed=11))
query("bootstrap_exact")(lambda spark, d: bootstrap.summary(bootstrap.resampled(_months(spark, d), bootstrap.exact_paths(_months(spark, d), 200, "circular", 6, 7)).groupBy("series", "rep").agg(F.avg("value").alias("statistic"))))
for _kind in ("mammen", "rademacher", "gaussian"):
    query(f"bootstrap_wild_{_kind}")(lambda spark, d, kind=_kind: bootstrap.summary(bootstrap.wild(_months(spark, d), 300, kind, 5).groupBy("series", "rep").agg(F.avg("value").alias("statistic"))))


@query("bootstrap_paired")
def bootstrap_paired(spark, d):
    p = _pairs(spark, d).withColumn("series", F.concat_ws("/", "i", "j"))
    x, y = bootstrap.series(p, "series", ["t"], "x"), bootstrap.series(p, "series", ["t"], "y")
    both = bootstrap.resampled(x, bootstrap.paths(x, 200, "circular", 6, 3), y)
    return bootstrap.summary(both.groupBy("series", "rep").agg(moments.pearson("value", "value2").alias("statistic")))


@query(
    "subsample",
    f"WITH {panels.SEGMENT_MONTHS_SQL}, k AS (SELECT asset AS series, value, row_number() OVER (PARTITION BY asset ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY asset) AS n FROM r), s AS (SELECT series, k, n, avg(value) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS v FROM k) SELECT series, k AS start, round(v, 6) AS statistic FROM s WHERE k <= n - 12",
)
def subsample(spark, d):
    return bootstrap.subsample(_months(spark, d), 12, lambda w: F.avg("value").over(w)).select("series", "start", _r("statistic").alias("statistic"))


@query("subsample_length", f"WITH {panels.SEGMENT_MONTHS_SQL} SELECT asset AS series, greatest(2, round_even(pow(count(*), 2.0 / 3), 0))::INT AS length FROM r GROUP BY 1")
def subsample_length(spark, d):
    return _months(spark, d).groupBy("series").agg(F.max("n").alias("n")).select("series", bootstrap.subsample_length(F.col("n")).alias("length"))


@query("bootstrap_double")
def bootstrap_double(spark, d):
    s = _months(spark, d)
    return bootstrap.fast_double_bootstrap(s, F.avg("value"), s.groupBy("series").agg(F.lit(0.0).alias("observed")), 200)


query("block_length")(lambda spark, d: bootstrap.block_length(_months(spark, d)))
query("harrell_davis")(lambda spark, d: bootstrap.harrell_davis(_months(spark, d), 0.9))
query("p_square")(lambda spark, d: bootstrap.p_square(bootstrap.series(panels.read(spark, d, "events"), "event_type", ["ts", "event_id"], "value"), 0.9))
query("random_pcg64")(lambda spark, d: random_streams.draws(spark, 8, 1000, 42))
query("random_xoshiro")(lambda spark, d: random_streams.draws(spark, 4, 1000, 42, "xoshiro"))
query("random_gaussian")(lambda spark, d: random_streams.draws(spark, 4, 1000, 42, kind="gaussian"))
query("random_int")(lambda spark, d: random_streams.draws(spark, 4, 1000, 42, kind="int", bound=6))


def _sobol_sql(dims: int, n: int, skip: int = 0) -> str:
    cols = []
    for k in range(dims):
        terms = [f"((g >> {i}) & 1) * {v}" for i, v in enumerate(qmc.direction_numbers(k + 1)) if (1 << i) <= 2 * (n + skip)]
        out = terms[0]
        for t in terms[1:]:
            out = f"xor({out}, {t})"
        cols.append(f"({out}) / 1073741824.0::DOUBLE AS x{k + 1}")
    return f"SELECT i, {', '.join(cols)} FROM (SELECT i, xor(i, i >> 1) AS g FROM range({1 + skip}, {n + skip + 1}) t(i))"


query("sobol", _sobol_sql(8, 4096))(lambda spark, d: qmc.sobol(spark, 4096, 8))
query("sobol_32", _sobol_sql(32, 1000, 100))(lambda spark, d: qmc.sobol(spark, 1000, 32, skip=100))


def _halton_sql(bases, n: int) -> str:
    cols = []
    for k, b in enumerate(bases):
        terms, power = [], 1
        while power <= n:
            terms.append(f"((i // {power}) % {b}) / {power * b}.0::DOUBLE")
            power *= b
        cols.append(f"round({' + '.join(terms)}, 12) AS x{k + 1}")
    return f"SELECT i, {', '.join(cols)} FROM range(1, {n + 1}) t(i)"


@query("halton", _halton_sql((2, 3, 5, 7), 4096))
def halton(spark, d):
    h = qmc.halton(spark, 4096, 4)
    return h.select("i", *(_r(f"x{k}", 12).alias(f"x{k}") for k in range(1, 5)))


@query("streaming_moments_batch", "SELECT date_trunc('day', ts) AS window_start, event_type, count(value) AS count, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY 1, 2")
def streaming_moments_batch(spark, d):
    from ..streaming import online

    w = online.windowed_moments(panels.read(spark, d, "events"), "ts", "value", "1 day", "1 hour", ["event_type"])
    return w.select("window_start", "event_type", "count", _r("mean").alias("mean"), _r("variance", 4).alias("variance"))


@query("streaming_moments", SQL["streaming_moments_batch"])
def streaming_moments(spark, d):
    """The same by a stream over the table's file, run until it has read all."""
    from ..streaming import online

    w = _drain(spark, d, lambda s: online.windowed_moments(s, "ts", "value", "1 day", "1 hour", ["event_type"]), "complete", ["window_start", "event_type"])
    return w.select("window_start", "event_type", "count", _r("mean").alias("mean"), _r("variance", 4).alias("variance"))


@query(
    "streaming_pearson",
    f"SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round({_PEARSON.format(x='value', y='user_id')}, 6) AS pearson, round(covar_samp(value, user_id / 1000.0::DOUBLE), 4) AS covariance FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2",
)
def streaming_pearson(spark, d):
    """Correlation and covariance by day from a stream over the table's file."""
    from ..streaming import online

    w = _drain(spark, d, lambda s: online.windowed_pearson(s.dropna(subset=["value", "user_id"]).withColumn("user", F.col("user_id") / 1000.0), "ts", "value", "user", "1 day", "1 hour", ["event_type"]), "complete", ["window_start", "event_type"])
    return w.select("window_start", "event_type", "n", _r("pearson").alias("pearson"), _r("covariance", 4).alias("covariance"))


@query("streaming_p_square")
def streaming_p_square(spark, d):
    from ..streaming import online

    return _drain(spark, d, lambda s: online.p_square(s, "event_type", "ts", "value", 0.9), "update", ["event_type"])


@query(
    "streaming_rolling_window",
    """SELECT event_type, (least(n, 10) - b)::INT AS k, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS b, count(*) OVER (PARTITION BY event_type) AS n
    FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL) WHERE b <= 10""",
)
def streaming_rolling_window(spark, d):
    """The last ten values of each event type, oldest first."""
    from ..streaming import online

    w = _drain(spark, d, lambda s: online.rolling_window(s, "event_type", "ts", "value", 10), "update", ["event_type"])
    return w.select("event_type", F.posexplode("window").alias("k", "value"))


def _drain(spark, d, plan, mode: str, keys: list[str]) -> DataFrame:
    """The last row of each key after a stream has read all; micro-batches are written to the shared folder."""
    from ..streaming.online import written

    schema = panels.read(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    return written(plan(source), mode, keys)
