"""Embedding texts and batch encoding, done again only for changed content.

Vectors are stored by content: the hash of the encoder's name and the text. An
update encodes each different text that the store lacks once, in batches, with
an encoder that a worker process makes once and keeps, and appends the vectors;
rows find theirs by hash. Encoders are injected; ``HashingEncoder`` needs no
model. Rows without text have no vector.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that an encoder is given at once.
BATCH = 64


class Encoder(Protocol):
    """``name`` tells models apart; ``load`` makes what encodes, in the worker."""

    name: str

    def load(self): ...

    def encode(self, model, texts: list[str]) -> np.ndarray: ...


@dataclass(frozen=True)
class HashingEncoder:
    """Signed counts of words by hashed bucket; the same everywhere."""

    size: int = 64

    @property
    def name(self) -> str:
        return f"hashing-{self.size}"

    def load(self):
        return re.compile("[a-z0-9]+")

    def encode(self, model, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts):
            for w in model.findall(text.lower()):
                digest = hashlib.md5(w.encode()).hexdigest()
                row[int(digest[:8], 16) % self.size] += 1 if digest[8] < "8" else -1
        return out


_LOADED: dict[str, object] = {}


def loaded(encoder: Encoder):
    """The encoder's model, made once in a worker process."""
    if encoder.name not in _LOADED:
        _LOADED[encoder.name] = encoder.load()
    return _LOADED[encoder.name]


def embedding_text(*parts: Column) -> Column:
    """The parts that have text, trimmed, with blanks between; null without any."""
    trimmed = F.array(*[F.trim(F.coalesce(p, F.lit(""))) for p in parts])
    return F.nullif(F.array_join(F.filter(trimmed, lambda t: t != ""), " "), F.lit(""))


def encoded(text: Column, encoder: Encoder, batch: int = BATCH) -> Column:
    """Unit vectors of texts (zero where an encoder finds nothing)."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(encoder)
        for s in series:
            texts, out = s.tolist(), []
            for at in range(0, len(texts), batch):
                rows = np.asarray(encoder.encode(model, texts[at : at + batch]), float)
                size = np.linalg.norm(rows, axis=1, keepdims=True)
                out += list(np.divide(rows, size, out=np.zeros_like(rows), where=size > 0))
            yield pd.Series(out)

    return run(text)


@dataclass
class VectorStore:
    """Vectors by content below ``path``."""

    spark: SparkSession
    path: str
    encoder: Encoder

    def key(self, text: Column) -> Column:
        return F.sha1(F.concat(F.lit(self.encoder.name + "|"), text))

    def vectors(self) -> DataFrame:
        """(key, embedding); texts that two updates encoded at the same time
        have equal vectors and count once."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "key string, embedding array<double>")
        return self.spark.read.schema("key string, embedding array<double>").parquet(self.path).dropDuplicates(["key"])

    def update(self, items: DataFrame, text: Column) -> None:
        """Encode and append what the store lacks of the items' texts."""
        texts = items.select(text.alias("text")).where("text is not null").distinct().withColumn("key", self.key(F.col("text")))
        fresh = texts.join(self.vectors().select("key"), "key", "left_anti")
        fresh.select("key", encoded(F.col("text"), self.encoder).alias("embedding")).write.mode("append").parquet(self.path)

    def attach(self, items: DataFrame, text: Column, name: str = "embedding") -> DataFrame:
        """Items with their vectors, null for those without one."""
        keyed = items.withColumn("key_", self.key(text))
        found = self.vectors().select(F.col("key").alias("k_"), F.col("embedding").alias(name))
        return keyed.join(found, F.col("key_") == F.col("k_"), "left").drop("key_", "k_")
