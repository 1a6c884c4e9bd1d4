"""Connected components of links between numbers, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stash


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id of ``links`` (a, b): comp is the smallest id it reaches.

    Each round takes the least label among the neighbours and then follows
    labels twice, so the rounds grow with the logarithm of the longest path.
    Minima are combined before the shuffle, so a node with very many links is
    no hot group; labels are written once a round and no plan grows.
    """
    two_way = stash(
        links.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct(),
        "links",
    )
    labels = two_way.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp"), F.lit(True).alias("moved"))
    while True:
        # labels of labels: every label is an id of its own
        labels = _jump(_jump(labels))
        near = two_way.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        labels = stash(
            labels.join(near, labels["id"] == near["a"], "left").select(
                "id", F.least("comp", "near").alias("comp"), F.coalesce(F.col("near") < F.col("comp"), F.lit(False)).alias("moved")
            ),
            "labels",
        )
        if labels.filter("moved").isEmpty():
            return labels.select("id", "comp")


def _jump(labels: DataFrame) -> DataFrame:
    """Each label is replaced by its own label."""
    to = labels.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
    return labels.join(to, "comp").select("id", F.least("comp", "next").alias("comp"), "moved")
