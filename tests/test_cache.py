"""The result cache: hits compute nothing, changed tables miss."""

import pytest

from siftwright.operators.cache import ResultCache, fingerprint, key_of
from siftwright.operators.graph import shared_path


def test_key_is_ordered_parts_with_pipes():
    import hashlib

    assert key_of("a", None, 3) == hashlib.sha1(b"a||3|").hexdigest() and key_of("ab") != key_of("a", "b")


def test_hits_misses_expiry_and_invalidation(spark):
    now = [1000.0]
    cache = ResultCache(spark, shared_path(spark, "cache"), 300, lambda: now[0])
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).selectExpr("id", "id * 2 AS twice")

    key = key_of("query", "review", "print")
    assert cache.get("r", key) is None
    first = cache.get_or_build("r", key, build)
    again = cache.get_or_build("r", key, build)
    assert len(calls) == 1 and sorted(first.collect()) == sorted(again.collect()) and again.schema == first.schema
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan and cache.path.split("/")[-1] in again.inputFiles()[0]
    assert cache.get("other", key) is None and cache.get("r", key_of("query", "debug", "print")) is None
    now[0] += 300
    assert cache.get("r", key) is not None
    now[0] += 1
    assert cache.get("r", key) is None
    cache.get_or_build("r", key, build)
    assert len(calls) == 2 and cache.sweep() == 1 and cache.get("r", key).count() == 5
    cache.put("s", key, build())
    cache.invalidate("r")
    assert cache.get("r", key) is None and cache.get("s", key) is not None
    cache.invalidate()
    assert cache.get("s", key) is None and cache.sweep() == 0
    cache.put("r", key, spark.createDataFrame([], "id long"))
    assert cache.get("r", key).count() == 0


def test_incomplete_entries_are_not_found(spark):
    cache = ResultCache(spark, shared_path(spark, "cache"))
    with pytest.raises(Exception, match="boom"):
        cache.put("r", "k", spark.range(3).selectExpr("raise_error('boom')"))
    assert cache.get("r", "k") is None


def test_fingerprint_changes_with_the_files(spark):
    path = shared_path(spark, "table")
    spark.range(3).write.parquet(path)
    first = fingerprint(spark.read.parquet(path))
    assert fingerprint(spark.read.parquet(path)) == first
    spark.range(1).write.mode("append").parquet(path)
    assert fingerprint(spark.read.parquet(path)) != first
