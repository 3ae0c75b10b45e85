"""The log's equations on hand-made entries."""

from __future__ import annotations

import pytest

from sparkdoc.operators import entries as E

SCHEMA = "key string, seq long, value string"
ROWS = [("a", 1, "x"), ("a", 5, "z"), ("a", 3, "y"), ("b", 2, "x"), ("b", 6, None), ("c", 4, "c"), ("é", 7, "e"), ("Z", 8, "Z"), ("d", 9, None)]


@pytest.fixture()
def log(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_latest_keeps_markers_and_live_drops_them_afterwards(log):
    assert sorted(rows(E.latest(log))) == [("Z", 8, "Z"), ("a", 5, "z"), ("b", 6, None), ("c", 4, "c"), ("d", 9, None), ("é", 7, "e")]
    assert rows(E.scan(log)) == [("Z", 8, "Z"), ("a", 5, "z"), ("c", 4, "c"), ("é", 7, "e")]


def test_get(log):
    assert rows(E.get(log, "a")) == [("a", 5, "z")]
    assert rows(E.get(log, "b")) == [("b", 6, None)]
    assert rows(E.get(log, "nobody")) == []


def test_pages(log):
    assert rows(E.scan_range(log, "", 2)) == [("Z", 8, "Z", True), ("a", 5, "z", True)]
    assert rows(E.scan_range(log, "a", 2)) == [("c", 4, "c", False), ("é", 7, "e", False)]
    assert rows(E.scan_range(log, "é", 2)) == [] and rows(E.scan_range(log, "", 0)) == []
    assert rows(E.has_more(log, "", 0)) == [(0, True)] and rows(E.has_more(log, "é", 0)) == [(0, False)]
    with pytest.raises(ValueError):
        E.scan_range(log, "", -1)


def test_changes_since_collapse_and_keep_deletions(log):
    assert rows(E.scan_since(log, 4)) == [("Z", 8, "Z", False), ("a", 5, "z", False), ("b", 6, None, True), ("d", 9, None, True), ("é", 7, "e", False)]


def test_as_of_merge_compact(log):
    assert rows(E.as_of(log, 3)) == [("a", 3, "y"), ("b", 2, "x")]
    old, new = log.where("seq <= 4"), log.where("seq > 4")
    assert rows(E.merge(old, new)) == rows(E.scan(log))
    assert sorted(rows(E.compact(old, new))) == sorted(rows(E.latest(log)))


def test_stats(log):
    assert rows(E.segment_stats(log)) == [("Z", "é", 1, 9, 9)]
    assert rows(E.segment_stats(log.limit(0))) == [("", "", 0, 0, 0)]
    assert rows(E.max_seq(log.limit(0))) == [(0,)] and rows(E.deleted(log)) == [("b", 6), ("d", 9)]


def test_empty_value_is_a_marker(spark):
    log = spark.createDataFrame([("a", 1, b"x"), ("a", 2, b"")], "key string, seq long, value binary")
    assert rows(E.scan(E.normalise(log))) == []


def test_key_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/log")
    plan = E.scan_range(spark.read.parquet(f"{tmp_path}/log"), "b", 2)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(key,b)" in plan and "TakeOrderedAndProject" in plan
