"""From raw documents to token ids: quality rules, line and document deduplication, mixing, tokenisation.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bpe, lines, minhash, mixing, rules
from quantloom.llm._store import stash
from quantloom.ship import ship

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go."""
    ship(spark)
    return rules.judge(docs).filter("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines of any length go, with n_chars counted again; so do documents that had words and are left without any."""
    ship(spark)
    out = lines.dedup(docs, exact_words=1)
    left = (F.col("n_removed") == 0) | F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.filter(left).withColumn("n_chars", chars).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Rows are taken out by their id: rows that share the id that stays all stay, and so do rows without an id.
    """
    ship(spark)
    gone = minhash.dedup(docs).filter(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    ship(spark)
    copies = F.coalesce(F.try_divide("taken", "size"), F.lit(0)).cast("int")
    taken = mixing.mix(docs).select("doc_id", copies.alias("copies")).groupBy("doc_id").agg(F.max("copies").alias("copies")).filter("copies > 0")
    taken = taken.withColumnRenamed("doc_id", "taken_id")
    out = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of the bytes decoded from them."""
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path(RANKS), with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Not given: neither fuzzy line links, near-duplicate components nor BPE merges are expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"stage{k}")
    return docs
