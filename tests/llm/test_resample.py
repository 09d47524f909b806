"""Importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwright.llm import queries, resample
from siftwright.llm.numbering import numbered
from tests.conftest import SMALL
from tests.llm.fixtures import documents, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target):
    """docs: (doc_id, text) rows; returns rows of doc_id, n_features, weight, score, rank."""
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return [(r[0], *r[2:]) for r in out]


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = rows(queries.QUERIES["op12_importance_resample"](spark, SMALL))
    assert same(got, brute(docs, target)) and sum(r[4] is not None for r in got) > 0


@pytest.mark.parametrize("size", [50, 1000, 1 << 16])
def test_odd_rows_and_any_chunk_size(spark, monkeypatch, size):
    monkeypatch.setattr(resample.Corpus.__init__, "__defaults__", ("doc_id", "text", size, 3))
    docs = documents() + [(500 + i, t, *[None] * 6) for i, t in enumerate(["x" * 5000, " " * 3000 + "a b" + "\n" * 3000 + "c", "A-b_C9 É日 ÄB"] + ["same words in all of these rows " * 5] * 40)]
    target = ["same words in all", None, "", "mufo tabi"]
    got = rows(resample.resample(frame(spark, docs), spark.createDataFrame([(t,) for t in target], "text string")))
    assert same(got, brute([r[:2] for r in docs], target))


def test_chunks_own_each_position_once():
    text = " ".join(f"w{i}" for i in range(3000)).encode()
    for size in (1, 7, 100, 10**6):
        found = [h for own, carried in resample.cut(text, size) for h in resample.hashes(own, carried)]
        assert Counter(found) == Counter(resample.hashes(text, b""))


def test_empty_tables(spark):
    some, none = frame(spark), frame(spark, [])
    assert resample.resample(none, some).count() == 0
    assert same(rows(resample.resample(some, none)), brute([r[:2] for r in documents()], []))


def test_numbers_within_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.when(F.col("id") % 7 > 0, "cold")).alias("k"), (F.col("id") % 40).alias("v"), "id")
    got = numbered(df, ["k"], [F.desc("v"), F.col("id")], "n").collect()
    for k in ("hot", "cold", None):
        mine = sorted((-r["v"], r["id"], r["n"]) for r in got if r["k"] == k)
        assert [n for *_, n in mine] == list(range(len(mine)))
