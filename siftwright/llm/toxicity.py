"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence is toxic with probability ``p = sigmoid(bias + sum of the weights of
its words)``, each different word once, where a word has the weight of its form
and of its beginnings, so inflected forms share a stem's weight; a document is toxic unless all of its
sentences are clean (noisy-or: ``1 - prod(1 - p)``). Only documents have labels;
the weights are fitted to them through the noisy-or, and the sentences whose own
``p`` reaches a threshold are the offending ones.

Training uses a sample of about ``SAMPLE`` labelled documents, taken by a hash
of their ids (all of them where there are fewer), each with its whole text.
Equal texts count once. Words that depend on the label (chi-squared over
documents) become the vocabulary, at most ``VOCABULARY`` of them; documents are
then lists of vocabulary ids by sentence, a small table. Every step adds up
the gradient over that table where its partitions lie (one row of at most
``VOCABULARY`` numbers a task comes back) and moves the weights by steps of
adaptive moments under an L1 penalty, which keeps the words that explain labels
and takes the weight off the others, such as those of copies of a toxic text. Scoring is
map-only over whole texts.

Null and empty texts are bags of no sentence: score 0, as for texts of marks
only. Of several labels of one id or one text, the toxic one counts; rows
of ``labels`` without id or label are passed over. A null doc_id is never held
out and never trains. Without any labelled row, or without both labels, no
weight is learned: every score is the share of toxic documents (0 without rows)
spread over sentences. Repeated rows get equal scores; empty tables give no
rows. Columns of clashing names pass through ``scored`` (added columns get
underscores).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import small_batches, staged, table, tmp_names, unstage

#: Labelled documents of the training sample, about; words of the vocabulary at
#: most; least documents and chi-squared of a word.
SAMPLE, VOCABULARY, LEAST_DOCS, LEAST_CHI = 20_000, 2_000, 2, 8.0
#: Steps of the training, their size, and nats that a weight of one must save;
#: weights below SMALL are set to zero after each step.
STEPS, RATE, L1 = 60, 0.2, 0.2
#: Score from which a document, or a sentence, counts as toxic.
THRESHOLD, SMALL = 0.5, 0.02
#: Lengths of a word's beginnings.
STEMS = range(3, 8)
SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def bag(text: str) -> list[tuple[int, int, set[str]]]:
    """(start, end, words) of every sentence with a word."""
    out = []
    for m in SENTENCE.finditer(text):
        if found := set(WORD.findall(m[0].lower())):
            out.append((m.start(), m.end(), found))
    return out


def forms(word: str) -> list[str]:
    """The features of a word: itself and its beginnings, marked by a star."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic): the sample, each text once."""
    given = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("of_doc")).agg(F.max("toxic").alias("toxic"))
    given = given.where(~held_out(F.col("of_doc")))
    share = min(1.0, sample / max(1, given.count()))
    given = given.where(F.pmod(F.xxhash64("of_doc"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(given), F.col("doc_id") == F.col("of_doc"))  # about ``sample`` ids and labels
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).where("text is not null")


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, toxic, n): documents with the feature; '' stands for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set().union(*(words for *_, words in bag(text)))
                for w in {"", *(f for w in words for f in forms(w))}:
                    found[w, toxic] = found.get((w, toxic), 0) + 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found], pa.int64()), pa.array([*found.values()], pa.int64())], ["word", "toxic", "n"])

    counted = rows.select("text", F.col("toxic").cast("long")).mapInArrow(run, "word string, toxic long, n long")
    return counted.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, toxic: int, total: int, most: int = VOCABULARY) -> list[str]:
    """Words of the greatest chi-squared between a document having them and its label."""
    rate = toxic / total
    expected = F.col("n") * rate
    chi = (F.col("toxic") - expected) ** 2 / (expected * (1 - rate) * F.greatest(1 - F.col("n") / total, F.lit(1e-9)))
    rows = counts.where((F.col("word") != "") & (F.col("n") >= LEAST_DOCS)).select("word", chi.alias("chi")).where(F.col("chi") >= LEAST_CHI)
    return [r["word"] for r in rows.orderBy(F.desc("chi"), "word").limit(most).collect()]  # ``most`` words


def coded(rows: DataFrame, words: list[str]) -> DataFrame:
    """(toxic, plain, ids, ends): sentences without a vocabulary word are counted,
    the others are runs of ids."""
    number = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, ids, ends = [], [], []
            for text in batch.column(0).to_pylist():
                known = [sorted(number[f] for w in found for f in forms(w) if f in number) for *_, found in bag(text)]
                some = [x for x in known if x]
                plain.append(len(known) - len(some))
                ids.append([i for x in some for i in x])
                ends.append(np.cumsum([len(x) for x in some], dtype=np.int64).tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(plain, pa.int64()), pa.array(ids, kind), pa.array(ends, kind)], ["toxic", "plain", "ids", "ends"])

    return rows.select("text", F.col("toxic").cast("long")).mapInArrow(run, "toxic long, plain long, ids array<bigint>, ends array<bigint>")


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def gradient(weights: np.ndarray, toxic: np.ndarray, plain: np.ndarray, ids: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient by weight (the bias is the last). ``ids`` are the words
    of all sentences one after another, ``ends`` the sentences' ends among them,
    ``doc`` each sentence's document."""
    bias = weights[-1]
    z = np.add.reduceat(weights[ids], np.concatenate([[0], ends[:-1]])) + bias if len(ends) else np.zeros(0)
    clean = plain * softplus(bias) + np.bincount(doc, softplus(z), len(toxic))  # -ln of the chance that all are clean
    clean = np.maximum(clean, 1e-12)
    missed = -np.log(-np.expm1(-clean))
    slope = np.where(toxic == 1, -1 / np.expm1(np.minimum(clean, 500)), 1.0)
    each = slope[doc] / (1 + np.exp(-z))
    out = np.bincount(ids, np.repeat(each, np.diff(ends, prepend=0)), len(weights))
    out[-1] = each.sum() + (slope * plain).sum() / (1 + np.exp(-bias))
    return float(np.where(toxic == 1, missed, clean).sum()), out


def total_gradient(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """The gradient over all rows, a list from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights))
        for batch in batches:
            n = batch.num_rows
            if n:
                ids, ends = batch.column(2), batch.column(3)
                words, sentences = np.diff(ids.offsets.to_numpy()), np.diff(ends.offsets.to_numpy())
                before = np.repeat(np.cumsum(words) - words, sentences)
                flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                _, found = gradient(weights, batch.column(0).to_numpy(), batch.column(1).to_numpy(), flat, ends.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + before, np.repeat(np.arange(n), sentences))
                total += found
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["g"])

    return np.sum([r["g"] for r in rows.mapInArrow(run, "g array<double>").collect()], axis=0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = STEPS) -> dict[str, float]:
    """Weights by word; the bias is that of ''."""
    spark = docs.sparkSession
    with small_batches(spark):
        rows = staged(training_rows(docs, labels, sample), "labelled", "zstd")
        counts = staged(word_counts(rows), "words")
        all_docs = counts.where("word = ''").first()
        toxic, total = (all_docs["toxic"], all_docs["n"]) if all_docs else (0, 0)
        bags = staged(coded(rows, words := vocabulary(counts, toxic, total) if 0 < toxic < total else []).coalesce(16), "bags")
    sentences = bags.agg(F.sum(F.col("plain") + F.size("ends"))).first()[0] or 1
    if not words:
        share = min(max(toxic / max(1, total), 1e-9), 1 - 1e-9)
        each = -np.expm1(np.log1p(-share) * total / sentences)
        return {"": float(np.log(each) - np.log1p(-each)) if toxic else -50.0}
    weights, mean, spread = np.zeros(len(words) + 1), 0.0, 0.0
    weights[-1] = np.log(toxic / sentences)
    for t in range(1, steps + 1):
        g = total_gradient(bags, weights) + np.append(L1 * np.sign(weights[:-1]), 0)
        mean, spread = 0.9 * mean + 0.1 * g, 0.99 * spread + 0.01 * g * g
        weights = weights - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-3)
        weights[:-1][np.abs(weights[:-1]) < SMALL] = 0
    for t in (rows, counts, bags):
        unstage(t)
    return {w: float(x) for w, x in zip([*words, ""], weights) if x or not w}


def judged(text: str, weights: dict[str, float]) -> tuple[float, list[tuple[int, int, float]]]:
    """A text's score, and (start, end, probability) of its offending sentences."""
    clean, found, bias = 0.0, [], weights[""]
    plain = float(softplus(np.float64(bias)))
    for start, end, words in bag(text):
        known = sorted(weights[f] for w in words for f in forms(w) if f in weights)
        if not known:
            clean += plain
            continue
        z = bias + sum(known)
        clean += float(softplus(np.float64(z)))
        if z >= np.log(THRESHOLD / (1 - THRESHOLD)):
            found.append((start, end, float(1 / (1 + np.exp(-z)))))
    return float(-np.expm1(-clean)), found


def scored(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """Add ``score`` and ``offending``: (start, end, p) of sentences, code points,
    end exclusive."""
    score, offending = tmp_names(docs, "score", "offending")

    @F.pandas_udf("score double, offending array<struct<start:bigint,end:bigint,p:double>>")
    def run(texts):
        import pandas as pd

        out = [judged(t or "", weights) for t in texts]
        return pd.DataFrame({"score": [x[0] for x in out], "offending": [[{"start": a, "end": b, "p": p} for a, b, p in x[1]] for x in out]})

    (both,) = tmp_names(docs, "judged_")
    done = docs.withColumn(both, run(F.col(text)))
    return done.select(*docs.columns, F.col(f"{both}.score").alias(score), F.col(f"{both}.offending").alias(offending))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    with small_batches(spark):
        found = scored(docs, weights)
        spans = F.array_join(F.transform("offending", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
        return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), spans.alias("offending"))
