"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as e


def test_registries_agree():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    rows = e.entry(spark).collect()
    assert len(rows) == 15 and all(0 <= r.delta <= 1 for r in rows)


def test_streams_give_the_batch_result(spark):
    q = e.queries()
    d = "/root/testdata/sf0.001"
    batch = {(r.window_start, r.event_type): r["count"] for r in q["streaming_moments_batch"](spark, d).collect()}
    stream = {(r.window_start, r.event_type): r["count"] for r in q["streaming_moments"](spark, d).collect()}
    assert batch == stream
    window = q["streaming_rolling_window"](spark, d).groupBy("event_type").agg({"k": "max", "value": "count"}).collect()
    assert len(window) == 5 and all(r["max(k)"] == 9 and r["count(value)"] == 10 for r in window)
    assert q["streaming_p_square"](spark, d).count() == 5
