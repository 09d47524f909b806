"""Retrieval-quality statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwright.functions import scores


def all_in_top_k(gold: Column, returned: Column, k: int) -> Column:
    """Whether every gold item is among the first ``k``."""
    return F.size(F.array_except(gold, F.slice(returned, 1, k))) == 0


def missing_of(gold: Column, returned: Column, k: int) -> Column:
    return F.array_except(gold, F.slice(returned, 1, k))


def precision(gold: Column, got: Column) -> Column:
    hits = F.size(F.array_intersect(gold, got))
    both_empty = (F.size(gold) == 0) & (F.size(got) == 0)
    return F.when(both_empty, 1.0).when(F.size(got) == 0, 0.0).otherwise(hits / F.size(F.array_distinct(got)))


def recall(gold: Column, got: Column) -> Column:
    hits = F.size(F.array_intersect(gold, got))
    both_empty = (F.size(gold) == 0) & (F.size(got) == 0)
    return F.when(both_empty, 1.0).when(F.size(gold) == 0, 0.0).otherwise(hits / F.size(F.array_distinct(gold)))


def with_prf(df: DataFrame, gold: str, got: str) -> DataFrame:
    out = df.withColumn("p", precision(F.col(gold), F.col(got))).withColumn("r", recall(F.col(gold), F.col(got)))
    return out.withColumn("f1", scores.f1(F.col("p"), F.col("r")))


def macro(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Averages per group and, in the row with a null group, over all tasks."""
    return df.rollup(by).agg(F.count("*").alias("tasks"), *[F.avg(m).alias(f"avg_{m}") for m in metrics])


def token_efficiency(recall_col: Column, tokens: Column) -> Column:
    return F.when(tokens <= 0, 0.0).otherwise(recall_col / tokens * 1000)


def read_cost(lines: Column, mean_chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(lines * mean_chars / 4)).cast("long")


def ci95(df: DataFrame, by: list[str], value: str, least: int = 10) -> DataFrame:
    """Mean and its 95 % interval, null below ``least`` runs."""
    g = df.groupBy(*by).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.when(F.col("runs") >= least, 1.96 * F.col("sd") / F.sqrt("runs"))
    return g.select(
        *by, "runs", F.round("mean", 3).alias("mean"),
        F.round(F.col("mean") - half, 3).alias("low"), F.round(F.col("mean") + half, 3).alias("high"),
    )


def aggregate_runs(df: DataFrame, by: list[str], run: str, success: Column, latency: str, carry: list[str]) -> DataFrame:
    """Mean and spread of latency; other values from the last good run."""
    last = F.max_by(F.struct(*carry), F.when(success, F.col(run)))
    g = df.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(success).alias("successes"), F.avg(latency).alias("mean_latency"),
        F.stddev_samp(latency).alias("sd_latency"), last.alias("last"),
    )
    return g.select(*by, "runs", "successes", "mean_latency", "sd_latency", *[F.col("last")[c].alias(c) for c in carry])


def signed_delta(value: Column, baseline: Column) -> Column:
    """Percent over (+) or under (-) a baseline; 0 where that is 0."""
    return F.when(baseline == 0, 0.0).otherwise(F.round(100.0 * (value - baseline) / baseline, 1))


def any_contains(titles: Column, fragment: Column) -> Column:
    return F.exists(titles, lambda t: F.contains(F.lower(t), F.lower(fragment)))


def rank_quality(conf: Column, least: float = 0.70) -> Column:
    """Share of items at or above a confidence; an aggregate."""
    return F.avg(F.when(conf >= least, 1.0).otherwise(0.0))


def gate(df: DataFrame, f1: str, ratio: str, least_f1: float = 0.80, least_ratio: float = 1.0) -> DataFrame:
    g = df.agg(F.avg(f1).alias("avg_f1"), F.avg(ratio).alias("avg_ratio"))
    return g.withColumn("passed", (F.col("avg_f1") >= least_f1) & (F.col("avg_ratio") >= least_ratio))


def path_suffix(a: Column, b: Column) -> Column:
    """Whether two paths are equal or one ends in the other at a slash."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def rank_one_hits(df: DataFrame, by: Sequence[str], gold: str, got: str) -> DataFrame:
    """(by..., tasks, rank1): tasks whose first result is a gold path."""
    hit = F.exists(F.col(gold), lambda g: path_suffix(F.get(F.col(got), 0), g))
    return df.groupBy(*by).agg(F.count("*").alias("tasks"), F.count_if(F.coalesce(hit, F.lit(False))).alias("rank1"))


def random_hits(df: DataFrame, by: Sequence[str], k: int, title: str, fragment: Column, seed: int = 7) -> DataFrame:
    """(by..., random_hit_rate): the hit rate of ``k`` rows a group drawn by a
    seeded hash of the title."""
    order = Window.partitionBy(*by).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(title))), title)
    drawn = df.withColumn("k_", F.row_number().over(order)).where(F.col("k_") <= k)
    return drawn.groupBy(*by).agg(F.max(F.contains(F.lower(title), F.lower(fragment)).cast("double")).alias("random_hit_rate"))


def summary(tasks: DataFrame) -> DataFrame:
    """One row over (success, reduction_pct, latency_ms, est_tokens, hit_rate,
    random_hit_rate, rank_quality): rates over all tasks, averages over those
    that succeeded, hit rates over those of them that any hit; 0 without any."""
    good = F.col("success")
    rated = good & ((F.col("hit_rate") > 0) | (F.col("random_hit_rate") > 0))
    mean = lambda c, cond, digits: F.round(F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0)), digits)
    kept = F.when(good, F.col("reduction_pct"))
    margin = 1.96 * F.stddev_samp(kept) / F.sqrt(F.count(kept))
    some = F.count(kept) >= 2
    return tasks.agg(
        F.count("*").alias("total_tasks"), F.round(F.coalesce(100.0 * F.count_if(good) / F.count("*"), F.lit(0.0)), 1).alias("success_rate"),
        mean("reduction_pct", good, 1).alias("avg_reduction_pct"), F.when(some, F.round(F.avg(kept) - margin, 1)).otherwise(0.0).alias("reduction_ci_low"),
        F.when(some, F.round(F.avg(kept) + margin, 1)).otherwise(0.0).alias("reduction_ci_high"), mean("latency_ms", F.lit(True), 1).alias("avg_latency_ms"),
        F.bround(F.coalesce(F.avg(F.when(good, F.col("est_tokens"))), F.lit(0.0)), 0).alias("avg_est_tokens"), mean("hit_rate", rated, 3).alias("avg_hit_rate"),
        mean("random_hit_rate", rated, 3).alias("avg_random_hit_rate"), mean("rank_quality", good, 3).alias("avg_rank_quality"),
    )


def holding(docs: DataFrame, passages: DataFrame, text: str = "text", passage: str = "passage") -> DataFrame:
    """Pairs of documents and passages that they hold.

    A passage's inner words (all but its first and last) are whole words of
    every text that holds it. So each passage is filed under that of its inner
    words which the fewest documents have, documents and passages meet by these
    words, and only such pairs are compared. A passage without inner words has a
    part that lies within one word of the text: it meets the documents of all
    the words that hold this part, found among the corpus's different words by
    runs of three characters (or single ones, for shorter parts). Null texts
    hold nothing; empty passages are in every other text.
    """
    found = docs.select(F.monotonically_increasing_id().alias("row_"), *docs.columns).where(F.col(text).isNotNull())
    wanted = passages.select(F.monotonically_increasing_id().alias("passage_"), *passages.columns).where(F.col(passage).isNotNull())
    wanted = wanted.withColumn("words_", _words(F.col(passage))).withColumn("inner_", F.array_distinct(F.slice(F.split(passage, SPACE), 2, F.greatest(F.size(F.split(passage, SPACE)) - 2, F.lit(0)))))
    texts = found.select("row_", F.explode(F.array_distinct(_words(F.col(text)))).alias("word_"))
    long = F.size("inner_") > 0
    pairs = _meet(texts, wanted.where(long).select("passage_", F.explode("inner_").alias("word_")))
    if not wanted.where(~long).isEmpty():
        pairs = pairs.unionByName(_meet_by_part(found, texts, wanted.where(~long), text, passage))
    out = pairs.join(found, "row_").join(wanted, "passage_").where(F.contains(text, F.col(passage)))
    return out.select(*docs.columns, *passages.columns)


SPACE = r"\s+"


def _words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def _meet(texts: DataFrame, filed: DataFrame) -> DataFrame:
    """(row_, passage_) by the rarest word of each passage. The texts' words are
    counted where they are read, as far as a passage has them."""
    keys = filed.select("word_").distinct()
    counts = texts.join(keys, "word_", "left_semi").groupBy("word_").agg(F.count("*").alias("docs_"))
    order = F.struct(F.coalesce("docs_", F.lit(0)).alias("n"), "word_")
    rarest = filed.join(counts, "word_", "left").groupBy("passage_").agg(F.min(order)["word_"].alias("word_"))
    return texts.join(rarest, "word_").select("row_", "passage_")


def _meet_by_part(found: DataFrame, texts: DataFrame, short: DataFrame, text: str, passage: str) -> DataFrame:
    """(row_, passage_) by the longest part of passages without inner words; those
    without any word by their first character, empty ones by none."""
    part = F.array_max(F.transform("words_", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    parts = short.select("passage_", part.alias("part_"))
    size = F.least(F.length("part_"), F.lit(3))
    known = texts.select("word_").distinct()
    out = None
    for n in (1, 2, 3):
        run = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n))))  # noqa: E731, B023
        grams = known.where(F.length("word_") >= n).select("word_", F.explode(run(F.col("word_"))).alias("gram_"))
        mine = parts.where(size == n).select("passage_", "part_", F.substring("part_", 1, n).alias("gram_"))
        met = grams.join(mine, "gram_").where(F.contains("word_", F.col("part_"))).select("word_", "passage_")
        out = met if out is None else out.unionByName(met)
    pairs = texts.join(out, "word_").select("row_", "passage_")
    blank = short.where(F.size("words_") == 0).select("passage_", F.substring(passage, 1, 1).alias("space_"))
    spaces = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(r"(\s)"), F.lit(1))))
    return pairs.unionByName(found.select("row_", F.explode(spaces).alias("space_")).join(blank, "space_").select("row_", "passage_")).distinct()
