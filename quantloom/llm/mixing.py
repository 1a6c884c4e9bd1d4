"""Mixing sources to target weights by Pareto order sampling (operator 7), native.

1. Sizes are summed by source; targets come from weights by water filling: a
   target stops at ``cap`` times its source's size and the excess goes to the
   others by weight until none is above. Sorted by size / weight the sources
   at their cap are a prefix, so one window finds the level, without a loop.
2. A source takes each document floor(target / size) times for certain. The
   rest of its target, a share f of its words, is a fixed-size sample: each
   document has an inclusion probability p with sum(p * size) = f * source size,
   larger for longer documents, and is ranked by the Pareto key
   u / (1 - u) / (p / (1 - p)), where u comes from a hash of doc_id and seed.
   Documents are taken in this order while the words fit, and the one on the
   edge if that brings the sum nearer.

The order is never built in one task for a hot source: keys fall in
``BUCKETS`` ranges, whose word sums place the edge; only the documents of
the edge's range are ordered in a window, a share 1 / BUCKETS of the source.

Defined cases: a null text has size 0 and gets the certain copies only; a null
source is a source of its own and comes last; equal keys are ordered by doc_id;
rows that repeat a doc_id are documents of their own with equal keys, ordered
together; a null doc_id hashes as such; an empty table gives an empty result;
other columns are not looked at and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import stash

#: Ranges of the sampling key.
BUCKETS = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    Sources in code point order, null last, get ``weights`` in turn. The row number needs
    all sources in one order; there is one small row for each.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    # the sources that reach their cap first come first: cap * size / weight ascending
    order = W.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    w = (
        w.withColumn("total", F.sum("source_size").over(every) * budget)
        .withColumn("left", F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("level", F.col("left") / F.col("weights_left"))
        .withColumn("capped", F.col("weight") * F.col("level") > cap * F.col("source_size"))
    )
    # the level of the first source that is not capped holds for all that follow
    level = F.min(F.when(~F.col("capped"), F.struct((F.col("source_size") / F.col("weight")).alias("o"), F.col("level")))).over(every)["level"]
    w = w.withColumn("final", level)
    target = F.least(cap * F.col("source_size"), F.coalesce(F.col("weight") * F.col("final"), cap * F.col("source_size")))
    return w.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", budget: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0), seed: int = 7) -> DataFrame:
    """(key, size, source_size, target, taken) for each row of ``docs``; taken counts words with repeats."""
    d = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    d = stash(d, "sizes")  # words are counted once; three plans read the three narrow columns
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) * (2.0**-53)
    g = F.col("size") / (F.col("size") + 256.0)  # in [0, 1), grows with the size
    d = d.withColumn("u", u).withColumn("g", g)
    sums = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("g") * F.col("size")).alias("g_size"))
    t = targets(sums.select("source", "source_size"), budget, cap, weights)
    plan = (
        sums.select(F.col("source").alias("s"), "g_size")
        .join(t, F.col("s").eqNullSafe(F.col("source")))
        .withColumn("ratio", F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))
        .withColumn("certain", F.floor(F.col("ratio") + 1e-12))
        .withColumn("f", F.greatest(F.lit(0.0), F.col("ratio") - F.col("certain")))
        .withColumn("mean_g", F.coalesce(F.try_divide(F.col("g_size"), F.col("source_size").cast("double")), F.lit(0.0)))
        .withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
        .select("s", "source_size", "target", "certain", "f", "mean_g", "rest")
    )
    # p = f + slope * (g - mean g) keeps sum(p * size) = f * source size and lies in (0, 1)
    slope = 0.9 * F.least(F.col("f"), 1 - F.col("f"))
    p = F.col("f") + slope * (F.col("g") - F.col("mean_g"))
    odds = F.col("u") / (1 - F.col("u")) * (1 - p) / p
    d = (
        d.join(plan, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("rank_key", F.when(p > 0, odds / (1 + odds)).otherwise(F.col("u")))  # in [0, 1], monotone in the Pareto key
        .withColumn("bucket", F.least(F.floor(F.col("rank_key") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    )
    by_bucket = W.partitionBy("s").orderBy("bucket")
    ranges = (
        d.groupBy("s", "bucket")
        .agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        .withColumn("before", F.sum("words").over(by_bucket) - F.col("words"))
        .withColumn("next_room", F.col("rest") - F.col("before"))
        .select(F.col("s").alias("rs"), F.col("bucket").alias("rb"), "words", "next_room")
    )
    # whole ranges are in or out; only a range that holds the edge is ordered, in parts no larger than it
    ranges = ranges.withColumn("place", F.when(F.col("words") <= F.col("next_room"), "in").when(F.col("next_room") <= 0, "out").otherwise("edge"))
    d = d.join(ranges, F.col("s").eqNullSafe(F.col("rs")) & (F.col("bucket") == F.col("rb")))
    edge = W.partitionBy("rs", "rb").orderBy("rank_key", "doc_id")
    on_edge = d.filter("place = 'edge'").withColumn("upto", F.sum("size").over(edge.rowsBetween(W.unboundedPreceding, 0)))
    # the document on the edge comes in if its words are nearer to the room left than none
    fits = (F.col("upto") <= F.col("next_room")) | ((F.col("upto") - F.col("size") < F.col("next_room")) & (F.col("upto") - F.col("next_room") < F.col("next_room") - (F.col("upto") - F.col("size"))))
    out = ["doc_id", "size", "source_size", "target"]
    taken = lambda extra: (F.col("size") * (F.col("certain") + extra)).cast("long").alias("taken")
    sure = d.filter("place <> 'edge'").select(*out, taken(F.when(F.col("place") == "in", 1).otherwise(0)))
    return sure.unionByName(on_edge.select(*out, taken(F.when(fits, 1).otherwise(0)))).withColumnRenamed("doc_id", key)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs)
