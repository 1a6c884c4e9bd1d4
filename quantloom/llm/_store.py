"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and all runs on one machine (tests), a local folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table.

    Cuts lineage and survives lost executors; the files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _LEFT:
        atexit.register(_sweep)
    _LEFT.append((spark, path))
    # what the written table no longer needs, shuffle files above all, goes now and not at some later collection
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, text: str = "text", name: str = "z", level: int = 3) -> DataFrame:
    """``df`` with each text compressed by itself, for a shuffle that is half as large; null is empty."""
    at, names = df.columns.index(text), [name if c == text else c for c in df.columns]
    schema = T.StructType([T.StructField(name, T.BinaryType()) if f.name == text else f for f in df.schema.fields])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=level)
        for b in batches:
            z = [pack.compress(x.as_buffer() if x.is_valid else b"") for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.binary()) if i == at else c for i, c in enumerate(b.columns)], names=names)

    return df.mapInArrow(run, schema)


def unpacked(column: pa.Array) -> pa.Array:
    """The texts of packed(), as bytes."""
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x.as_buffer()) if x.is_valid else None for x in column], pa.binary())


def _sweep() -> None:
    for spark, path in _LEFT:
        try:
            if spark.sparkContext._jsc is None:
                return
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may already be gone
            return
