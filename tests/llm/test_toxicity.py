"""Multiple-instance toxicity: gradients, held-out accuracy, located sentences."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright.llm import queries, toxicity
from tests.llm.fixtures import documents, frame

SF = "/root/testdata/sf0.1"


def noisy_or_loss(weights, bags):
    total = 0.0
    for toxic, sentences in bags:
        p = [1 / (1 + np.exp(-(weights[-1] + sum(weights[i] for i in s)))) for s in sentences]
        clean = np.prod([1 - x for x in p])
        total -= np.log(1 - clean) if toxic else np.log(clean)
    return total


def test_gradient_equals_differences_of_the_brute_force_loss(spark):
    rng = np.random.default_rng(0)
    bags = [(int(rng.integers(2)), [[int(i) for i in rng.integers(0, 5, rng.integers(0, 4))] for _ in range(rng.integers(1, 6))]) for _ in range(12)]
    rows = []
    for toxic, sentences in bags:
        some = [s for s in sentences if s]
        rows.append((toxic, len(sentences) - len(some), [i for s in some for i in s], np.cumsum([len(s) for s in some], dtype=int).tolist()))
    table = spark.createDataFrame(rows, "toxic long, plain long, ids array<bigint>, ends array<bigint>").repartition(3)
    weights = rng.normal(size=6)
    got = toxicity.total_gradient(table, weights)
    for k in range(6):
        e = np.zeros(6)
        e[k] = 1e-6
        want = (noisy_or_loss(weights + e, bags) - noisy_or_loss(weights - e, bags)) / 2e-6
        assert got[k] == pytest.approx(want, rel=1e-4, abs=1e-5)


def test_query_on_held_out_documents(spark):
    got = queries.QUERIES["op13_toxicity"](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert (toxic.predicted == 1).mean() >= 0.85 and (clean.predicted == 1).mean() <= 0.01
    ranks = held.score.rank()
    auc = (ranks[held.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / len(toxic) / len(clean)
    assert auc >= 0.98
    assert (got[got.predicted == 1].offending != "").mean() >= 0.95


def rows_of(texts):
    return [(i, t, *[None] * 6) for i, t in enumerate(texts)]


def test_offending_sentences_are_located(spark):
    texts = [f"Mild words number{i} here. {'You vile' if i % 2 else 'A fine'} thing{i}! Then rest{i} follows\nand ends" for i in range(120)]
    docs = frame(spark, rows_of(texts))
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    weights = toxicity.train(docs.select("doc_id", "text"), labels)
    found = {r["doc_id"]: r for r in toxicity.scored(docs, weights).collect()}
    for i, t in enumerate(texts):
        spans = [t[s["start"] : s["end"]].strip() for s in found[i]["offending"]]
        assert spans == ([f"You vile thing{i}"] if i % 2 else []) and (found[i]["score"] >= 0.5) == bool(i % 2)


def test_labels_of_held_out_documents_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels, steps=5), toxicity.train(docs, turned, steps=5)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_odd_rows_and_labels(spark):
    rows = documents()
    docs = frame(spark, rows).withColumns({c: F.lit("own") for c in ("score", "judged_")})
    narrow = docs.select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0), (999, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        weights = toxicity.train(narrow, labels)
        got = toxicity.scored(docs, weights)
        assert got.columns == [*docs.columns, "score_", "offending"] and got.where("score <> 'own' or judged_ <> 'own'").count() == 0
        out = got.collect()
        assert len(out) == len(rows) and all(0 <= r["score_"] <= 1 for r in out)
        assert all(r["score_"] == 0 for r in out if not (r["text"] or "").strip())
    assert toxicity.scored(frame(spark, []), {"": -1.0}).count() == 0
    assert toxicity.train(frame(spark, []).select("doc_id", "text"), odd).keys() == {""}
