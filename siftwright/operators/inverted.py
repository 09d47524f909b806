"""A stored inverted index: stemmed prefix search in BM25 order.

``build`` writes a row for each word stem and item, with its count and the item's
length, partitioned by the stem's first two characters and sorted by stem, and
one row of totals. ``search`` reads the partitions of its terms only, within
them the row groups whose stems can match, and never the texts; it shuffles the
matching rows once, by item. A term matches every stem that starts with the
term's own stem, as a disjunction.

Words are runs of letters and digits, lower-cased and without accents. Null and
empty texts are items without words: they count in the totals and are never
found. Ids must be unique. A query without words finds nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions.porter import stem
from siftwright.operators.graph import staged

#: The usual constants of this dialect of BM25 (not those of
#: ``retrieval.bm25``), and the least weight of a term.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Rows of a postings file, about.
FILE_ROWS = 2_000_000
WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=50_000)
def folded(word: str) -> str:
    return word if word.isascii() else "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def stems(text: str) -> list[str]:
    return [stem(folded(w)) for w in WORD.findall(text.lower())]


def part_of(word: str) -> str:
    """The partition of a stem: its first two letters or digits where it has
    them; a ``-`` stands for others and for none."""
    first = [c if c.isascii() else "-" for c in word[:2]]
    return "".join(first).ljust(2, "-")


def parts_of(term: str) -> Column:
    """Partitions that can hold stems which start with ``term``."""
    if len(term) > 1:
        return F.col("part") == part_of(term)
    return F.col("part").startswith(part_of(term)[0])


def postings(df: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """(id, word, n, length): an item's stems with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, words, counts, lengths, parts = [], [], [], [], []
            for i, texts in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                found = Counter(w for t in texts if t for w in stems(t))
                at += [i] * len(found)
                words += found
                counts += found.values()
                lengths += [sum(found.values())] * len(found)
            parts = [part_of(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.string())],
                ["id", "word", "n", "length", "part"],
            )

    return df.select(F.col(id).alias("id"), *[F.col(c).cast("string") for c in columns]).mapInArrow(run, f"id {dict(df.dtypes)[id]}, word string, n long, length long, part string")


def build(df: DataFrame, id: str, columns: Sequence[str], path: str) -> None:
    """Write the index of ``columns`` to ``path``."""
    rows = staged(postings(df, id, columns))
    size = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("words")).first()
    files = max(1, -(-size["rows"] // FILE_ROWS))
    ranged = rows.repartitionByRange(files, "part", "word", "id").sortWithinPartitions("part", "word", "id")
    ranged.write.partitionBy("part").parquet(f"{path}/postings")
    totals = df.agg(F.count("*").alias("items"), F.max(F.lit(None).cast(dict(df.dtypes)[id])).alias("id"))  # a null that keeps the ids' type
    totals.withColumn("words", F.lit(size["words"] or 0).cast("long")).write.parquet(f"{path}/totals")


def search(spark: SparkSession, path: str, query: str, limit: int | None = 200) -> DataFrame:
    """(id, score) of the items that a term's prefix meets, best first; all of
    them where ``limit`` is None."""
    terms = Counter(stems(query))
    totals = spark.read.parquet(f"{path}/totals")
    rows = spark.read.schema(f"id {dict(totals.dtypes)['id']}, word string, n long, length long, part string").parquet(f"{path}/postings")
    where, meets = F.lit(False), F.lit(False)
    for t in terms:
        where, meets = where | parts_of(t), meets | F.col("word").startswith(t)
    listed = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hits = rows.where(where).where(meets).withColumn("term", F.explode(F.filter(listed, lambda t: F.startswith("word", t))))
    hits = hits.groupBy("id", "term").agg(F.sum("n").alias("n"), F.max("length").alias("length"))
    with_term = hits.groupBy(F.col("term").alias("of_term")).agg(F.count("*").alias("items_with"))
    weight = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("items") - F.col("items_with") + 0.5) / (F.col("items_with") + 0.5)))
    times = F.create_map(*[F.lit(x) for kv in terms.items() for x in kv]) if terms else F.lit(None)
    weights = with_term.crossJoin(F.broadcast(totals)).select("of_term", weight.alias("idf"), (F.col("words") / F.col("items")).alias("mean"))  # a row per term, one of totals
    length = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    score = F.col("idf") * F.col("n") * (K1 + 1) / (F.col("n") + length) * (times[F.col("term")] if terms else F.lit(0))
    scored = hits.join(F.broadcast(weights), F.col("term") == F.col("of_term")).groupBy("id").agg(F.round(F.sum(score), 9).alias("score"))
    ordered = scored.orderBy(F.desc("score"), "id")
    return ordered if limit is None else ordered.limit(limit)
