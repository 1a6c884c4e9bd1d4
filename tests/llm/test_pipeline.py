"""The pipeline on a small fixture, stage by stage against brute force."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm import corpus  # noqa: E402


def test_stages(spark, tmp_path):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(corpus())]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        kept.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert kept[0] > kept[2] > 0 and kept[3] == kept[4]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "n_tokens", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "n_tokens", "ids_sha256").collect()))


def test_one_of_each_group_stays(spark):
    base = "one two three four five six seven eight nine ten " * 3
    rows = [(1, base, "en", "s", 9), (2, base, "en", "s", 9), (3, base + "eleven", "en", "t", 9), (4, None, "en", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [1, 4]
    mixed = corpus_pipeline.mix_sources(spark, df, "")
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
