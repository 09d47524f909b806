"""Corpus pipeline: quality rules, near copies, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it back as the next stage's docs. All but the last return the columns of
``documents``. Null texts are empty and go at the quality rules; an empty table
passes through as an empty table. Repeated rows are judged alike, and one of them
stays after the near copies; ties there go to the least doc_id. Further columns
of any name, those that an operator adds included, pass through as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import mixing, packing, quality, simhash
from siftwright.llm import secret_scan as secrets
from siftwright.llm.common import staged, table, tmp_names

#: SimHash distance of candidates, words of a shingle and least similarity of
#: the exact check in the near-copy stage.
RADIUS, LEAST = 3, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    (kept,) = tmp_names(docs, "kept")
    return quality.judge(docs).where(F.col(kept)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies."""
    return simhash.drop_near_copies(docs, radius=RADIUS, least=LEAST).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark, and n_chars to match."""
    found = secrets.find(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    (spans,) = tmp_names(docs, "secret_spans")
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target asks for."""
    (copies,) = tmp_names(docs, "copies")
    mixed = mixing.mix(docs, carry=copies).where(F.col(copies) > 0)
    return mixed.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SimHash, mixing's duals and token ids are beyond SQL; tests/llm holds the
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name, "zstd")
    return docs
