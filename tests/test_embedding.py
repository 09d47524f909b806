"""Embedding texts, the hashing encoder, and encoding by content."""

import numpy as np
from pyspark.sql import functions as F

from siftwright.operators.embedding import HashingEncoder, VectorStore, embedding_text
from siftwright.operators.graph import shared_path

SCHEMA = "id long, name string, signature string, doc string"


def text():
    return embedding_text(F.col("name"), F.col("signature"), F.col("doc"))


def test_text_of_parts(spark):
    rows = [(1, " a ", "f(x)", None), (2, "", None, "  "), (3, None, "g", "doc ")]
    assert [r["t"] for r in spark.createDataFrame(rows, SCHEMA).select(text().alias("t")).collect()] == ["a f(x)", None, "g doc"]


def test_only_new_content_is_encoded(spark):
    class Counting(HashingEncoder):
        """Refuses texts that should not be encoded again."""

        def encode(self, model, texts):
            assert not any("known" in t for t in texts), texts
            return HashingEncoder.encode(self, model, texts)

    path = shared_path(spark, "vectors")
    first = spark.createDataFrame([(1, "known one", "f()", ""), (2, "known two", None, None), (3, None, None, None), (4, "known one", "f()", None)], SCHEMA)
    VectorStore(spark, path, HashingEncoder(32)).update(first, text())
    store = VectorStore(spark, path, Counting(32))
    assert store.vectors().count() == 2
    second = first.union(spark.createDataFrame([(5, "fresh", "h()", "x"), (6, "!!", "", "")], SCHEMA))
    store.update(second, text())
    store.update(second, text())
    got = {r["id"]: r["embedding"] for r in store.attach(second, text()).collect()}
    assert store.vectors().count() == 4 and len(got) == 6 and got[3] is None and got[1] == got[4] and not np.any(got[6])
    raw = HashingEncoder(32).encode(HashingEncoder(32).load(), ["known one f()"])[0]
    assert np.allclose(got[1], raw / np.linalg.norm(raw))


def test_encoders_have_their_own_vectors(spark):
    path = shared_path(spark, "vectors")
    df = spark.createDataFrame([(1, "a", "b", "c")], SCHEMA)
    VectorStore(spark, path, HashingEncoder(8)).update(df, text())
    other = VectorStore(spark, path, HashingEncoder(16))
    assert other.attach(df, text()).first()["embedding"] is None
    other.update(df, text())
    assert len(other.attach(df, text()).first()["embedding"]) == 16
    assert VectorStore(spark, shared_path(spark, "none"), HashingEncoder()).attach(df, text()).first()["embedding"] is None
