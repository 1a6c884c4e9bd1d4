"""Root finding for a table of problems: rows of a batch iterate together in a vectorised kernel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..kernels import roots

RESULT = [("root", T.DoubleType()), ("converged", T.BooleanType()), ("iterations", T.LongType()), ("final_residual", T.DoubleType()), ("estimated_error", T.DoubleType())]
BRACKETED = {"bisection": roots.bisection, "brent": roots.brent, "newton_bracketed": roots.newton_bracketed}
OPEN = {"newton": roots.newton, "secant": roots.secant, "muller": roots.muller}


def solve(df: DataFrame, f: Callable[[np.ndarray, pd.DataFrame], np.ndarray], method: str = "brent", lower: str = "lower", upper: str = "upper", guess: str = "guess", **options) -> DataFrame:
    """df with root, converged, iterations, final_residual and estimated_error.

    f(x, rows) values the objective at x for the given rows of df; bracketed
    methods read ``lower`` and ``upper``, the others ``guess``.
    """
    if method not in BRACKETED | OPEN:
        raise ValueError(f"unknown method {method}; one of {', '.join(BRACKETED | OPEN)}")
    names = df.columns

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            objective = lambda x, rows: np.asarray(f(x, frame.iloc[rows]), float)  # noqa: B023, E731
            got = BRACKETED[method](objective, frame[lower], frame[upper], **options) if method in BRACKETED else OPEN[method](objective, frame[guess], **options)
            yield frame[names].assign(**got)

    return df.mapInPandas(run, T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in RESULT)]))
