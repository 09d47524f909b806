"""Resampling towards a target distribution by hashed n-gram importance weights.

A document's features are all runs of 1 to ``ORDER`` consecutive words, hashed
into buckets. The gain of a bucket is the log ratio of its smoothed share in the
target texts and in the corpus; a document's weight is the sum of its features'
gains, and adding Gumbel noise and keeping the highest scores draws documents
without replacement in proportion to the exponential of their weights.

Overlap chunking: a text of more than ``CHUNK`` bytes is split at word
boundaries into chunks that own their starting positions and carry the next
``ORDER - 1`` words along, so every run of words starts in one chunk exactly.
Chunks of long texts are dealt over all tasks; counts and weights are summed by
document. Shorter texts are worked on where they are read.

Both passes over the words are map-only and send on one row per bucket and task
or per chunk. The gains (a row per bucket, whatever the input) go to the tasks
by value. Ranks come from range partitions, so no task sorts all documents.

Null texts have no words: weight 0, never drawn. A null doc_id counts as an
empty string where scores are drawn. Repeated rows are separate documents; equal
(score, doc_id) rank in any order among themselves. Empty tables give no rows;
an empty target leaves the smoothed ratio against no counts. Further columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import small_batches, staged, table, unstage
from siftwright.llm.numbering import numbered

BUCKETS, ORDER, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of a text from which it is split, and of its chunks.
CHUNK = 1 << 16
#: Every byte that is no letter, digit or part of another character is a blank;
#: A-Z are lower-cased.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> bytes:
    """The text with its words as they are, lower-cased, and blanks between."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD)


def cut(folded: bytes, size: int, order: int = ORDER) -> Iterator[tuple[bytes, bytes]]:
    """(own words, carried words) of each chunk of about ``size`` bytes."""
    folded, at = re.sub(rb" +", b" ", folded), 0
    while at < len(folded):
        to = folded.find(b" ", at + size)
        to = len(folded) if to < 0 else to
        carried, end = [], to
        while len(carried) < order - 1 and end < len(folded):
            nxt = folded.find(b" ", end + 1)
            nxt = len(folded) if nxt < 0 else nxt
            carried += folded[end:nxt].split()
            end = nxt
        yield folded[at:to], b" ".join(carried)
        at = to


def hashes(own: bytes, carried: bytes, order: int = ORDER) -> list[int]:
    """CRC-32 of every run of 1 to ``order`` words that starts among ``own``."""
    mine = own.split()
    after = [b" " + w for w in (*mine, *carried.split())]
    last = list(map(crc32, mine))
    out = list(last)
    for k in range(1, order):
        last = list(map(crc32, after[k : k + len(mine)], last))
        out += last
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = CHUNK, order: int = ORDER) -> DataFrame:
    """(doc_id, row, own, carried) of the texts of more than ``size`` bytes;
    ``row`` tells rows apart, also where doc_id is null or repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, row = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                for own, carried in cut(words(batch.column(1)[i].as_py()), size, order):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc], pa.int64()), pa.array([row], pa.int64()), pa.array([own], pa.binary()), pa.array([carried], pa.binary())],
                        ["doc_id", "row", "own", "carried"],
                    )

    long = docs.where(F.octet_length(text) > size).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return long.mapInArrow(run, "doc_id long, row long, own binary, carried binary")


class Corpus:
    """Documents as shorter texts where they are, and staged chunks of the others."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = CHUNK, order: int = ORDER):
        with small_batches(docs.sparkSession, 20):
            self.long = staged(chunks(docs, id_col, text, size, order).hint("rebalance"), "chunks", "zstd")
        whole = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) <= size)
        own = F.coalesce(F.col(text), F.lit("")).cast("binary")
        self.short = whole.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), own.alias("own"), F.lit(b"").alias("carried"))
        self.order = order

    def rows(self, of, schema: str) -> DataFrame:
        """``of(list of (own, carried))`` for batches of both kinds."""
        both = [self.short.mapInArrow(of, schema), self.long.mapInArrow(of, schema)]
        return both[0].unionByName(both[1])

    def counts(self, buckets: int = BUCKETS) -> DataFrame:
        """(bucket, n): features of all documents by bucket; a task adds its own up."""
        order = self.order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets, np.int64)
            for batch in batches:
                for own, carried in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    total += np.bincount(np.array(hashes(own.translate(FOLD), carried, order), np.int64) % buckets, minlength=buckets)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

        return self.rows(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))

    def weighed(self, gains: np.ndarray) -> DataFrame:
        """(doc_id, n_words, n_features, weight), a row per document."""
        order = self.order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, n_features, weight = [], [], []
                for own, carried in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    own = own.translate(FOLD)
                    found = np.array(hashes(own, carried, order), np.int64) % len(gains)
                    n_words.append(len(own.split()))
                    n_features.append(len(found))
                    weight.append(int(gains[found].sum()))
                more = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *more], ["doc_id", "row", "n_words", "n_features", "weight"])

        schema = "doc_id long, row long, n_words long, n_features long, weight long"
        sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
        long = self.long.mapInArrow(run, schema).groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums)
        names = ["doc_id", "n_words", "n_features", "weight"]
        return self.short.mapInArrow(run, schema).select(*names).unionByName(long.select(*names))


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) by bucket."""
    s_all, t_all = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    ratio = [(target.get(b, 0) + 1) * s_all / ((corpus.get(b, 0) + 1) * t_all) for b in range(buckets)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; rank
    is null where a document is not drawn."""
    corpus, wanted = Corpus(docs, id_col, text), Corpus(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")))
    found = [{r["bucket"]: r["n"] for r in x.counts(buckets).collect()} for x in (corpus, wanted)]  # a row per bucket at most
    weighed = corpus.weighed(gains_of(*found, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
    scored = staged(weighed.withColumn("score", F.col("weight") + noise), "scored")
    unstage(corpus.long)
    unstage(wanted.long)
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = numbered(scored.where(able).select(*names), [], [F.desc("score"), F.asc_nulls_last("doc_id")], "nth")
    rank = F.when(F.col("nth") < drawn, F.col("nth") + 1)
    rest = scored.where(~able).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, rank.cast("long").alias("rank")).unionByName(rest)


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
