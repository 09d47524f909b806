"""Ranked retrieval: BM25, boosts, semantic and rerank blends."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import scores
from siftwright.functions import text as tx
from siftwright.operators.graph import staged

K1, B = 1.5, 0.75
#: Fixed value: file names in a query.
FILE_NAME = r"\b(\w[\w.-]+\.\w{2,6})\b"


def bm25(df: DataFrame, query: str, text: Column, name: str = "bm25", keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``name``: Okapi BM25 of distinct tokens, divided by its maximum.

    Texts are tokenized once: one scan writes the columns to ``keep`` (all, if
    None; leave the text out where it isn't needed further), the number of
    tokens and a flag for each of the query's tokens to a narrow table, and the
    one-row aggregates (rows, mean length, document frequencies, the maximum)
    and the scores come from there. Rows are not exploded or shuffled, and
    nothing reaches the driver.
    """
    words = tx.query_tokens(query)
    length, hits, n, mean, top = "len_", [f"hit{i}_" for i in range(len(words))], "n_", "mean_", "top_"
    kept = list(df.columns if keep is None else keep)
    flags = F.transform(F.array(tx.tokens(text)), lambda t: F.struct(F.size(t).alias("n"), *[F.array_contains(t, w).alias(h) for h, w in zip(hits, words)]))
    held = df.select(*kept, F.element_at(flags, 1).alias("t_"))
    held = staged(held.select(*kept, F.col("t_.n").alias(length), *[F.col(f"t_.{h}").alias(h) for h in hits]))
    stats = held.agg(F.count("*").alias(n), F.avg(length).alias(mean), *[F.count_if(h).alias(f"df_{h}") for h in hits])
    score, share = F.lit(0.0), K1 * (1 - B + B * F.col(length) / F.coalesce(F.nullif(mean, F.lit(0.0)), F.lit(1.0)))
    for h in hits:
        idf = F.ln((F.col(n) - F.col(f"df_{h}") + 0.5) / (F.col(f"df_{h}") + 0.5) + 1)
        score = score + F.when(F.col(h), idf * (K1 + 1) / (1 + share)).otherwise(0.0)
    scored = held.join(F.broadcast(stats), how="cross").withColumn(name, score)  # one row each
    best = scored.agg(F.max(name).alias(top))
    out = scored.join(F.broadcast(best), how="cross")
    return out.withColumn(name, F.when(F.col(top) > 0, F.col(name) / F.col(top)).otherwise(0.0)).select(*kept, name)


def blend(conf: Column, score: Column) -> Column:
    return scores.capped(0.6 * conf + 0.4 * score)


def stem_boost(conf: Column, path: Column, query: str) -> Column:
    """Items whose file stem is a query token gain 30 %; tests do not."""
    named = F.regexp_replace(F.lower(tx.stem(path)), "[-.]", "_")
    hit = named.isin(tx.query_tokens(query)) & ~tx.is_test_path(path)
    return F.when(hit, scores.capped(conf * 1.3)).otherwise(conf)


def filename_boost(conf: Column, path: Column, query: str) -> Column:
    """Items that the query names by file name gain 0.4."""
    import re

    names = [n.lower() for n in re.findall(FILE_NAME, query) if not n.startswith("http")]
    return F.when(F.lower(tx.basename(path)).isin(names), scores.capped(conf + 0.4)).otherwise(conf)


def prefix_search(df: DataFrame, query: str, text: Column, order: Sequence[str], limit: int = 200) -> DataFrame:
    """Rows with a token that starts with a query token, most such first."""
    words = tx.query_tokens(query)

    def has(word: str) -> Column:
        return F.exists(tx.tokens(text), lambda t: t.startswith(word)).cast("int")

    count = sum((has(w) for w in words), F.lit(0))
    return df.withColumn("matched", count).where("matched > 0").orderBy(F.desc("matched"), *order).limit(limit)


def recency_retrieval(df: DataFrame, score: Column, age: Column, name: str = "score") -> DataFrame:
    boost = scores.recency(age)
    return df.withColumn(name, F.when(score > 0, 1 + score * boost).otherwise(boost))


def semantic_boost(conf: Column, similarity: Column) -> Column:
    gain = F.least(F.lit(0.15), F.greatest(F.lit(0.0), similarity - 0.3) * 0.3)
    return scores.capped(conf + gain)


def rerank(df: DataFrame, conf: str, scorer: Callable[[DataFrame], DataFrame], path: Column, order: Sequence[str], top: int = 30) -> DataFrame:
    """Blend the first ``top`` rows with an injected scorer's ``rerank_score``."""
    first = df.orderBy(F.desc(conf), *order).limit(top)
    scored = scorer(first)
    fresh = 0.5 * F.col(conf) + 0.5 / (1 + F.exp(-F.col("rerank_score")))
    factor = F.when(tx.is_test_path(path), 0.85).otherwise(1.15)
    return scored.withColumn(conf, F.greatest(F.lit(0.0), scores.capped(fresh * factor)))


def widened(df: DataFrame, query: str, path: Column, changed: Column | None = None) -> DataFrame:
    """Rows whose file stem shares a token with the query, less stop words. Where
    ``changed`` gives a row's changed paths, only those rows widen for which
    nothing but documentation has changed."""
    words = [w for w in tx.query_tokens(query) if w not in tx.STOP]
    hit = F.arrays_overlap(tx.tokens(tx.stem(path)), F.array(*[F.lit(w) for w in words]).cast("array<string>"))
    if changed is not None:
        hit = hit & ((F.coalesce(F.size(changed), F.lit(0)) <= 0) | tx.docs_only(changed))
    return df.where(hit)


def keyword_baseline(df: DataFrame, query: str, text: Column, order: Sequence[str], limit: int = 50) -> DataFrame:
    words = [w.lower() for w in query.split() if len(w) > 2]
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(text), F.lit(w))
    return df.where(hit).orderBy(*order).limit(limit)
