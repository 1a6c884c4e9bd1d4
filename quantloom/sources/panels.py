"""Series and panels from tables: the canonical long form (panel, t, asset, value) and adapters to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def from_wide(df: DataFrame, t: str, assets: Sequence[str], panel: Column | None = None) -> DataFrame:
    """One row for each asset from one column for each asset."""
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("asset"), F.col(a).cast("double").alias("value")) for a in assets)))
    return df.select((panel if panel is not None else F.lit("panel")).alias("panel"), F.col(t).alias("t"), pairs.alias("p")).select("panel", "t", "p.asset", "p.value")


def from_arrays(df: DataFrame, t: str, values: str, panel: Column | None = None) -> DataFrame:
    """One row for each asset, numbered from 0, from an array column; arrays of different lengths are ragged and raise."""
    rows = df.select((panel if panel is not None else F.lit("panel")).alias("panel"), F.col(t).alias("t"), F.col(values).alias("v"))
    width = F.max(F.size("v")).over(W.partitionBy("panel"))
    rows = rows.withColumn("v", F.when(F.size("v") == width, F.col("v")).otherwise(F.raise_error(F.lit("ragged panel"))))
    return rows.select("panel", "t", F.posexplode("v").alias("asset", "value")).withColumn("value", F.col("value").cast("double"))


def complete(panel: DataFrame) -> DataFrame:
    """Only the times at which every asset of the panel has exactly one non-null value."""
    ok = panel.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    assets = ok.groupBy("panel").agg(F.countDistinct("asset").alias("k"))
    times = ok.groupBy("panel", "t").agg(F.countDistinct("asset").alias("n"), F.count(F.lit(1)).alias("m"))
    times = times.join(assets, "panel").filter("n = k and m = k").select("panel", "t")
    return ok.join(times, ["panel", "t"])


def log_returns(panel: DataFrame) -> DataFrame:
    """ln(v / previous v) of each asset by t; the first time is lost."""
    w = W.partitionBy("panel", "asset").orderBy("t")
    return panel.withColumn("value", F.ln(F.col("value") / F.lag("value").over(w))).filter("value is not null")


def segment_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly log returns of order value by market segment."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    value = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.date_trunc("month", "o_orderdate").alias("t"), F.col("c_mktsegment").alias("asset"))
        .agg(F.sum("o_totalprice").alias("value"))
        .withColumn("panel", F.lit("segment"))
    )
    return log_returns(complete(value)).select("panel", "t", "asset", "value")


SEGMENT_MONTHS_SQL = """
cells AS (SELECT date_trunc('month', o_orderdate) AS t, c_mktsegment AS asset, sum(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
full_t AS (SELECT t FROM cells GROUP BY t HAVING count(*) = (SELECT count(DISTINCT asset) FROM cells)),
r AS (SELECT * FROM (SELECT t, asset, ln(v / lag(v) OVER (PARTITION BY asset ORDER BY t)) AS value FROM cells JOIN full_t USING (t)) WHERE value IS NOT NULL)
"""


def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of event values by type, and their differences."""
    events = read(spark, sf_dir, "events").select("ts", "event_type", "value")
    hours = events.groupBy(F.lit("events").alias("panel"), F.date_trunc("hour", "ts").alias("t"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("value"))
    return complete(hours)


EVENT_HOURS_SQL = """
hours AS (SELECT date_trunc('hour', ts) AS t, event_type AS asset, avg(value) AS value FROM events GROUP BY 1, 2),
full_h AS (SELECT t FROM hours GROUP BY t HAVING count(*) = (SELECT count(DISTINCT asset) FROM hours)),
h AS (SELECT t, asset, value FROM hours JOIN full_h USING (t))
"""


def embedding_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' components as assets: long, with 64 assets."""
    e = read(spark, sf_dir, "embeddings").filter("embedding is not null")
    return from_arrays(e, "vec_id", "embedding")
