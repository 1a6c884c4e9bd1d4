"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int):
    """crc32 of the key as text, modulo ``modulus``; a null key has none and counts as 0 of no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % modulus, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text, y) of at most ``most`` labelled ids, the first by a hash of the id; several labels of an id are averaged and rounded."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.round(F.avg(F.col(label).cast("double"))).cast("int").alias("y"))
        .orderBy(F.xxhash64(key), key)
        .limit(most)
    )
    # the bound makes the broadcast safe: ``most`` numbers
    return docs.select(key, text).join(F.broadcast(ids), key)
