"""The thin queries of the ten operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, crosspoly, lines, minhash, mixing, quality, rules, sql, suffix, toxicity, urls


def base_counts(spark, sf_dir: str) -> DataFrame:
    """The part of op10 that SQL expresses: counts and the base rule of every document."""
    return rules.query(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """The part of op7 that SQL expresses: sizes and targets of every document."""
    return mixing.query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {
    "op1_url_reputation": urls.query,
    "op2_hyperminhash": minhash.query,
    "op3_gam_quality": quality.query,
    "op4_fuzzy_lines": lines.query,
    "op5_suffix_intervals": suffix.query,
    "op6_cross_polytope": crosspoly.query,
    "op7_pareto_mix": mixing.query,
    "op8_bpe": bpe.query,
    "op9_toxic_neighbours": toxicity.query,
    "op10_compression_rules": rules.query,
    "rules_base_counts": base_counts,
    "mix_targets": mix_targets,
}
SQL: dict[str, str] = {
    "op1_url_reputation": urls.SQL,
    "op2_hyperminhash": sql.MINHASH,
    "op6_cross_polytope": sql.EMBEDDINGS,
    "rules_base_counts": sql.BASE_COUNTS,
    "mix_targets": sql.TARGETS,
}
