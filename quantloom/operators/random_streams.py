"""Reproducible random streams as generators: one substream for each stream number, whatever the partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..kernels.rng import Gaussian, Pcg64, Xoshiro


def draws(spark: SparkSession, streams: int, count: int, seed: int = 0, generator: str = "pcg64", kind: str = "uniform", bound: int = 0) -> DataFrame:
    """(stream, k, value): count draws of each stream from 1.

    generator: pcg64 (stream numbers pick the increment) or xoshiro (stream s is s - 1 jumps ahead).
    kind: uniform, gaussian or int (0 to bound - 1).
    """

    def source(stream: int):
        if generator == "pcg64":
            return Pcg64(seed, stream)
        if generator != "xoshiro":
            raise ValueError(f"unknown generator {generator}")
        g = Xoshiro(seed)
        for _ in range(stream - 1):
            g.jump()
        return g

    def run(frames):
        for f in frames:
            for stream in f.id:
                g = source(int(stream))
                if kind == "gaussian":
                    v = Gaussian(g).batch(count)
                elif kind == "int":
                    v = g.ints(count, bound).astype(float)
                else:
                    v = np.fromiter((g.next_double() for _ in range(count)), float, count)
                yield pd.DataFrame({"stream": int(stream), "k": np.arange(count), "value": v})

    return spark.range(1, streams + 1).mapInPandas(run, "stream long, k long, value double")
