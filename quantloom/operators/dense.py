"""Small dense problems, one for each group: numpy kernels behind applyInPandas and grouped arrays.

The unit of parallelism is the panel, matrix, model or problem; a group is one
matrix. Groups arrive packed, so a kernel sees arrays and never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import fit, linalg, spectral


def pack_panel(panel: DataFrame) -> DataFrame:
    """(panel, assets, t, x): the panel's values as arrays in order of t and asset."""
    rows = panel.groupBy("panel", "t").agg(F.array_sort(F.collect_list(F.struct("asset", "value"))).alias("v"))
    rows = rows.groupBy("panel").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("r"))
    return rows.select("panel", F.transform(F.col("r")[0]["v"], lambda x: x["asset"].cast("string")).alias("assets"), F.size("r").alias("t"), F.transform("r", lambda x: F.transform(x["v"], lambda y: y["value"])).alias("x"))


def pack_matrix(m: DataFrame, key: str = "panel") -> DataFrame:
    """(key, labels, a): entries (key, i, j, value) as arrays; one triangle is enough."""
    both = m.select(key, "i", "j", "value").unionByName(m.filter("i <> j").select(key, F.col("j").alias("i"), F.col("i").alias("j"), "value")).dropDuplicates([key, "i", "j"])
    rows = both.groupBy(key, "i").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("v"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("r"))
    return rows.select(key, F.transform("r", lambda x: x["i"].cast("string")).alias("labels"), F.transform("r", lambda x: F.transform(x["v"], lambda y: y["value"])).alias("a"))


def _grid(a) -> np.ndarray:
    return np.array([np.asarray(row, float) for row in a])


def each(df: DataFrame, kernel: Callable[[pd.Series], list[dict]], schema: str) -> DataFrame:
    """kernel(row) for each packed row, which gives any number of result rows."""

    def run(frames):
        for frame in frames:
            out = [r for _, row in frame.iterrows() for r in kernel(row)]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return df.mapInPandas(run, schema)


def _entries(labels: Sequence[str], a: np.ndarray, **more) -> list[dict]:
    return [more | {"i": labels[i], "j": labels[j], "value": float(a[i, j])} for i in range(a.shape[0]) for j in range(i, a.shape[1])]


ENTRY = "panel string, i string, j string, value double"


def spectral_covariance(panel: DataFrame, kind: str, **options) -> DataFrame:
    """(panel, i, j, value), i <= j: one of spectral.ESTIMATORS on each panel."""
    estimate = spectral.ESTIMATORS[kind]
    return each(pack_panel(panel), lambda r: _entries(list(r.assets), estimate(_grid(r.x), **options), panel=r.panel), ENTRY)


def map_matrix(m: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(panel, i, j, value) of f(matrix), all entries."""

    def kernel(r):
        a, labels = f(_grid(r.a)), list(r.labels)
        return [{"panel": r.panel, "i": labels[i], "j": labels[j], "value": float(a[i, j])} for i in range(len(a)) for j in range(len(a))]

    return each(pack_matrix(m), kernel, ENTRY)


def cholesky(m: DataFrame) -> DataFrame:
    return map_matrix(m, linalg.cholesky)


def eigen_clip(m: DataFrame, tolerance: float = 0.0) -> DataFrame:
    return map_matrix(m, lambda a: linalg.eigen_clip(a, tolerance))


def higham(m: DataFrame, rounds: int = 100, tolerance: float = 1e-12) -> DataFrame:
    return map_matrix(m, lambda a: linalg.higham(a, rounds, tolerance))


def is_psd(m: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    return each(pack_matrix(m), lambda r: [{"panel": r.panel, "psd": linalg.is_psd(_grid(r.a), tolerance)}], "panel string, psd boolean")


def pivoted_cholesky(m: DataFrame, tolerance: float = 0.0, max_rank: int | None = None) -> DataFrame:
    """(panel, rank, permutation, lower): lower is in permuted order."""

    def kernel(r):
        lower, order, rank = linalg.pivoted_cholesky(_grid(r.a), tolerance, max_rank)
        return [{"panel": r.panel, "rank": rank, "permutation": order.tolist(), "lower": lower.tolist()}]

    return each(pack_matrix(m), kernel, "panel string, rank int, permutation array<int>, lower array<array<double>>")


def solve(m: DataFrame, rhs: DataFrame, method: str = "gaussian") -> DataFrame:
    """(panel, i, value): solutions for right sides (panel, i, value); gaussian or cholesky."""
    b = rhs.groupBy("panel").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("b")).select("panel", F.transform("b", lambda x: x["value"]).alias("b"))

    def kernel(r):
        a, v = _grid(r.a), np.asarray(r.b, float)
        x = linalg.solve(a, v) if method == "gaussian" else linalg.cholesky_solve(linalg.cholesky(a), v)
        return [{"panel": r.panel, "i": label, "value": float(y)} for label, y in zip(r.labels, x, strict=True)]

    return each(pack_matrix(m).join(b, "panel"), kernel, "panel string, i string, value double")


def eigen(m: DataFrame) -> DataFrame:
    """(panel, k, eigenvalue, vector): descending; the sign of vectors is free."""

    def kernel(r):
        values, vectors = linalg.eigen(_grid(r.a))
        return [{"panel": r.panel, "k": k + 1, "eigenvalue": float(v), "vector": vectors[:, k].tolist()} for k, v in enumerate(values)]

    return each(pack_matrix(m), kernel, "panel string, k int, eigenvalue double, vector array<double>")


PCA = "panel string, k int, eigenvalue double, ratio double, cumulative double, vector array<double>, mean array<double>"


def _components(panel: str, p: dict) -> list[dict]:
    mean = p.get("mean", np.zeros(0)).tolist()
    return [{"panel": panel, "k": k + 1, "eigenvalue": float(p["values"][k]), "ratio": float(p["ratio"][k]), "cumulative": float(p["cumulative"][k]), "vector": p["vectors"][:, k].tolist(), "mean": mean} for k in range(len(p["values"]))]


def pca_covariance(m: DataFrame) -> DataFrame:
    """Components of covariance matrices, signs fixed by each largest entry; mean is empty."""
    return each(pack_matrix(m), lambda r: _components(r.panel, linalg.pca(_grid(r.a))), PCA)


def pca_returns(panel: DataFrame, standardize: bool = False) -> DataFrame:
    """Components of panels: means and covariances are native aggregates, only N x N numbers reach Python."""
    from . import covariance

    mean = panel.groupBy("panel", "asset").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    cov = covariance.sample(panel)
    means = mean.groupBy("panel").agg(F.array_sort(F.collect_list(F.struct("asset", "m", "sd"))).alias("ms")).select("panel", F.transform("ms", lambda x: x["m"]).alias("mean"), F.transform("ms", lambda x: x["sd"]).alias("sd"))

    def kernel(r):
        a = _grid(r.a)
        if standardize:
            sd = np.asarray(r.sd, float)
            if (sd <= 0).any():
                raise ValueError("an asset has no variance")
            a = a / np.outer(sd, sd)
        return _components(r.panel, linalg.pca((a + a.T) / 2) | {"mean": np.asarray(r["mean"], float)})

    return each(pack_matrix(cov).join(means, "panel"), kernel, PCA)


def components_needed(pca: DataFrame, threshold: float) -> DataFrame:
    """(panel, n): components until the cumulative share reaches the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    return pca.groupBy("panel").agg(F.coalesce(F.min(F.when(F.col("cumulative") >= threshold, F.col("k"))), F.max("k")).alias("n"))


def project(panel: DataFrame, pca: DataFrame, k: int) -> DataFrame:
    """(panel, t, k, score): centred by the components' mean if they have one; never divided by deviations."""
    rank = F.dense_rank()
    from pyspark.sql import Window as W

    values = panel.withColumn("at", rank.over(W.partitionBy("panel").orderBy("asset")) - 1)
    loads = pca.filter(F.col("k") <= k).select("panel", "k", "mean", F.posexplode("vector").alias("at", "load"))
    centre = F.when(F.size("mean") > 0, F.get("mean", F.col("at"))).otherwise(0.0)
    loads = loads.select("panel", "k", "at", "load", centre.alias("centre"))
    return values.join(loads, ["panel", "at"]).groupBy("panel", "t", "k").agg(F.sum((F.col("value") - F.col("centre")) * F.col("load")).alias("score"))


def min_variance(cov: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(panel, asset, weight) of least variance for covariances (panel, i, j, value)."""
    return each(pack_matrix(cov), lambda r: [{"panel": r.panel, "asset": a, "weight": float(w)} for a, w in zip(r.labels, fit.min_variance(_grid(r.a), low, high), strict=True)], "panel string, asset string, weight double")


def mean_variance(cov: DataFrame, means: DataFrame, aversion: float, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(panel, asset, weight) for covariances and means (panel, asset, value)."""
    m = means.groupBy("panel").agg(F.array_sort(F.collect_list(F.struct("asset", "value"))).alias("m")).select("panel", F.transform("m", lambda x: x["value"]).alias("m"))
    return each(pack_matrix(cov).join(m, "panel"), lambda r: [{"panel": r.panel, "asset": a, "weight": float(w)} for a, w in zip(r.labels, fit.mean_variance(_grid(r.a), np.asarray(r.m, float), aversion, low, high), strict=True)], "panel string, asset string, weight double")


def ols(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], intercept: bool = True) -> DataFrame:
    """(keys, coefficients, standard_errors, rss, sigma, dof, r_squared) by pivoted QR of each group's rows."""
    rows = df.select(*keys, y, *xs)
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        r = linalg.ols(frame[list(xs)].to_numpy(float), frame[y].to_numpy(float), intercept)
        own = {k: frame[k].iloc[0] for k in keys}
        return pd.DataFrame([own | {c: (r[c].tolist() if isinstance(r[c], np.ndarray) else r[c]) for c in ("coefficients", "standard_errors", "rss", "sigma", "dof", "r_squared")}])

    return rows.dropna().groupBy(*keys).applyInPandas(one, f"{kinds}, coefficients array<double>, standard_errors array<double>, rss double, sigma double, dof long, r_squared double")


def ols_normal(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], intercept: bool = True) -> DataFrame:
    """(keys, coefficients, rss, dof, r_squared) for groups of any size: cross products of centred columns are summed in
    Spark and only they are solved, at the cost of the squared condition number."""
    cols = [y, *xs]
    d = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in cols)).dropna()
    mean = d.groupBy(*keys).agg(*(F.avg(c).alias(f"__m{i}") for i, c in enumerate(cols)))
    z = d.join(mean, list(keys))
    own = [(F.col(c) - F.col(f"__m{i}")) if intercept else F.col(c) for i, c in enumerate(cols)]
    sums = [F.sum(own[i] * own[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    g = z.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.first(f"__m{i}").alias(f"m{i}") for i in range(len(cols))), *sums)
    p = len(xs)
    kinds = ", ".join(f"{k} {dict(d.dtypes)[k]}" for k in keys)

    def run(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                s = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)], float)
                scale = np.sqrt(s.diagonal()[1:])
                b = np.linalg.solve(s[1:, 1:] / np.outer(scale, scale), s[1:, 0] / scale) / scale
                rss = s[0, 0] - b @ s[1:, 0]
                first = [r["m0"] - b @ np.array([r[f"m{i}"] for i in range(1, p + 1)])] if intercept else []
                out.append({k: r[k] for k in keys} | {"coefficients": [*map(float, first), *b.tolist()], "rss": float(rss), "dof": int(r["n"]) - p - intercept, "r_squared": float(1 - rss / s[0, 0]) if s[0, 0] > 0 else 0.0})
            yield pd.DataFrame(out, columns=[*keys, "coefficients", "rss", "dof", "r_squared"])

    return g.mapInPandas(run, f"{kinds}, coefficients array<double>, rss double, dof long, r_squared double")


def least_squares(df: DataFrame, t: str, y: str, model: Callable, start: Sequence[float], keys: Sequence[str], **options) -> DataFrame:
    """(keys, parameters, cost, converged, iterations, reason): model(p, t) fitted to each group by Levenberg-Marquardt."""
    rows = df.select(*keys, t, y).dropna()
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([t, y])
        a, b = frame[t].to_numpy(float), frame[y].to_numpy(float)
        r = fit.levenberg_marquardt(lambda p: model(p, a) - b, start, **options)
        return pd.DataFrame([{k: frame[k].iloc[0] for k in keys} | {"parameters": r["parameters"].tolist(), "cost": r["cost"], "converged": r["converged"], "iterations": r["iterations"], "reason": r["reason"]}])

    return rows.groupBy(*keys).applyInPandas(one, f"{kinds}, parameters array<double>, cost double, converged boolean, iterations long, reason string")
