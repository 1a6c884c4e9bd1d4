"""Sends the package to the executors, so that their Python workers can import its kernels."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's source files to the application once; returns the session."""
    sc = spark.sparkContext
    if sc.applicationId not in _DONE:
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="quantloom-"), "quantloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("quantloom", os.path.relpath(full, root)))
        sc.addPyFile(path)
        _DONE.add(sc.applicationId)
    return spark
