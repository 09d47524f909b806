"""Temporal memory: freshness, staleness, provenance, feedback, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwright.functions import scores
from siftwright.functions import text as tx

#: Deltas of feedback and the reports that a path needs.
DELTAS = {"missing": 0.05, "noisy": -0.10, "read": 0.03}
GATE = 3
DORMANT_DAYS = 90


def freshness(df: DataFrame, conf: Column, at: Column, count: Column, as_of: Column) -> DataFrame:
    age = scores.age_days(at, as_of)
    return df.withColumn("decay", scores.decay(age)).withColumn("effective", scores.effective_confidence(conf, age, count))


def stale_all_missing(notes: DataFrame, index: DataFrame, id_col: str, files: str) -> DataFrame:
    """Ids of notes with files none of which is in the index (path)."""
    touched = notes.select(id_col, F.explode(files).alias("path"))
    known = index.select("path").distinct().withColumn("known", F.lit(1))
    joined = touched.join(known, "path", "left")
    return joined.groupBy(id_col).agg(F.count("known").alias("n")).where("n = 0").select(id_col)


def stale_reason(notes: DataFrame, index: DataFrame, renames: DataFrame, as_of: Column, id_col: str, path: str, at: str) -> DataFrame:
    """renamed or missing_file for a path that is gone; dormant past 90 days."""
    known = index.select(F.col("path").alias("p_")).distinct().withColumn("known_", F.lit(True))
    moved = renames.select(F.col("old_path").alias("o_"), F.col("new_path").alias("new_path"))
    joined = notes.join(known, F.col(path) == F.col("p_"), "left").join(moved, F.col(path) == F.col("o_"), "left")
    days = F.datediff(as_of, F.col(at))
    reason = F.when(F.col("known_").isNull(), F.when(F.col("new_path").isNotNull(), "renamed").otherwise("missing_file")).when(days > DORMANT_DAYS, "dormant")
    return joined.withColumn("stale_reason", reason).drop("p_", "known_", "o_")


#: Orders of memory: by freshness, by confidence as recorded, and by time.
ORDERS = ("decayed", "confidence", "recent")


def ordered(df: DataFrame, by: str, conf: Column, at: Column, count: Column, as_of: Column, ord: str, limit: int | None = None) -> DataFrame:
    """Notes with ``score``, best first by one of ``ORDERS``."""
    if by not in ORDERS:
        raise ValueError(f"order {by!r} is none of {', '.join(ORDERS)}")
    score = {"decayed": scores.effective_confidence(conf, scores.age_days(at, as_of), count), "confidence": conf, "recent": F.unix_micros(at.cast("timestamp")).cast("double")}[by]
    out = df.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), ord)
    return out if limit is None else out.limit(limit)


def provenance(notes: DataFrame, committed: DataFrame, staged: DataFrame, path: str, on_main: bool = False) -> DataFrame:
    """committed, staged or branch_local; on the main branch only committed."""
    c = committed.select(F.col("path").alias("c_")).distinct()
    s = staged.select(F.col("path").alias("s_")).distinct()
    joined = notes.join(c, F.col(path) == F.col("c_"), "left").join(s, F.col(path) == F.col("s_"), "left")
    kind = F.when(F.col("c_").isNotNull(), "committed").when(F.col("s_").isNotNull(), "staged").otherwise("branch_local")
    out = joined.withColumn("provenance", kind).drop("c_", "s_")
    return out.where("provenance = 'committed'") if on_main else out


def ttl_live(cache: DataFrame, now: Column, ttl_seconds: int = 300, at: str = "inserted_at") -> DataFrame:
    return cache.where(F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp")) <= ttl_seconds)


def cache_key(*parts: Column) -> Column:
    """SHA-1 of the parts, a pipe after each."""
    return F.sha1(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("|"))]))


def tag_overlap(df: DataFrame, tags: str, wanted: Sequence[str], status: str | None = None) -> DataFrame:
    want = F.array(*[F.lit(w.lower()) for w in wanted])
    out = df.where(F.arrays_overlap(F.transform(tags, F.lower), want))
    return out.where(F.col(status) != "superseded") if status else out


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last writer wins."""
    over = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth_", F.row_number().over(over)).where("nth_ = 1").drop("nth_")


def upsert(base: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def replace_by_key(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of a key that ``fresh`` holds are replaced by its rows."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def access_counts(df: DataFrame, log: DataFrame, key: str, at: str) -> DataFrame:
    """Fold an append-only access log into counts and last access."""
    folded = log.groupBy(key).agg(F.count("*").alias("access_count"), F.max(at).alias("last_accessed_at"))
    return df.join(folded, key, "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))


def supersede_chain(links: DataFrame) -> DataFrame:
    """(id, final, hops) by following (old, new) links to their end, however far.
    Links jump to their target's target, so rounds grow with the logarithm of
    the longest chain; each is staged. A link of a cycle ends at its cycle's
    least id, with no hops (null)."""
    from siftwright.operators.graph import staged

    at = staged(links.select(F.col("old").alias("id"), F.col("new").alias("final"), F.lit(1).cast("long").alias("hops")))
    bound = max(1, at.count())
    while True:
        nxt = at.select(F.col("id").alias("o_"), F.col("final").alias("n_"), F.col("hops").alias("h_"))
        joined = at.join(nxt, F.col("final") == F.col("o_"), "left")
        hops = F.col("hops") + F.coalesce("h_", F.lit(0).cast("long"))
        moved = staged(joined.select("id", F.coalesce("n_", "final").alias("final"), hops.alias("hops"), F.col("n_").isNotNull().alias("moved_")))
        at = moved.drop("moved_")
        # A walk of more hops than there are links is in a cycle.
        if moved.where(F.col("moved_") & (F.col("hops") <= 2 * bound)).isEmpty():
            break
    loops = at.where(F.col("hops") > bound).select("id", "final")
    if loops.isEmpty():
        return at.withColumn("hops", F.col("hops").cast("int"))
    from siftwright.operators.graph import components

    around = components(loops.join(links, F.col("id") == F.col("old")).select(F.col("old").alias("src"), F.col("new").alias("dst")), loops.select(F.col("id").alias("node")))
    named = around.select(F.col("node").alias("c_"), F.col("component").alias("least_"))
    out = at.join(named, F.col("id") == F.col("c_"), "left")
    return out.select("id", F.coalesce("least_", "final").alias("final"), F.when(F.col("least_").isNull(), F.col("hops")).cast("int").alias("hops"))


def capture(notes: DataFrame, known_hashes: DataFrame, kind: Column, summary: Column, n_files: Column, order: Sequence[str], least: int = 1) -> DataFrame:
    """Notes with enough files, one per hash of type and summary head, that are
    not known yet."""
    hashed = notes.where(n_files >= least).withColumn("task_hash", tx.short_hash(F.concat_ws(":", kind, F.substring(summary, 1, 80))))
    fresh = hashed.join(known_hashes.select("task_hash").distinct(), "task_hash", "left_anti")
    return latest_per_key(fresh, ["task_hash"], [F.asc(o) for o in order])


def in_scope(scope: Column, wanted: str = "") -> Column:
    """Feedback of a repository and of none; all of it for an empty scope."""
    return F.lit(True) if not wanted else scope.isin(wanted, "")


def feedback_stats(fb: DataFrame, by: Sequence[str] = (), useful: str = "useful", missing: str = "missing", noisy: str = "noisy", read: str = "files_read", top: int = 5, least: int = 5) -> DataFrame:
    """(by..., total, n_useful, n_not_useful, useful_pct, top_missing, top_noisy,
    n_with_reads, read_overlap_pct, noise_ratio_pct). The share of useful reports
    is of all; top paths go by count, then path; the read shares are null below
    ``least`` reports with reads. Null lists count as empty."""
    reads = F.array_distinct(F.coalesce(F.col(read), F.array().cast("array<string>")))
    noise = F.coalesce(F.col(noisy), F.array().cast("array<string>"))
    share = F.when(F.size(reads) > 0, F.size(F.array_intersect(reads, noise)) / F.size(reads))
    total = fb.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col(useful)).alias("n_useful"), F.count_if(~F.col(useful)).alias("n_not_useful"),
        F.count(share).alias("n_with_reads"), F.avg(1 - share).alias("o_"), F.avg(share).alias("x_"),
    )
    out = total.withColumn("useful_pct", F.when(F.col("total") > 0, F.round(100.0 * F.col("n_useful") / F.col("total"), 1)).otherwise(0.0))
    for name, col in (("top_missing", missing), ("top_noisy", noisy)):
        counts = fb.select(*by, F.explode(col).alias("path")).groupBy(*by, "path").agg(F.count("*").alias("n"))
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "path")
        best = counts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
        lists = best.groupBy(*[F.col(b).alias(f"{b}_b") for b in by]).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias(name))
        on = F.lit(True)
        for b in by:
            on = on & F.col(b).eqNullSafe(F.col(f"{b}_b"))
        out = out.join(lists, on, "left").drop(*[f"{b}_b" for b in by])
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    enough = F.col("n_with_reads") >= least
    return out.select(
        *by, "total", "n_useful", "n_not_useful", "useful_pct", "top_missing", "top_noisy", "n_with_reads",
        F.when(enough, F.round(100 * F.col("o_"), 1)).alias("read_overlap_pct"), F.when(enough, F.round(100 * F.col("x_"), 1)).alias("noise_ratio_pct"),
    )


def feedback_deltas(fb: DataFrame, weight: Column | None = None, lists: dict[str, str] | None = None) -> DataFrame:
    """(path, delta): each kind counts from ``GATE`` reports on, scaled by the
    mean weight of its reports."""
    lists = lists or {"missing": "missing", "noisy": "noisy", "read": "files_read"}
    weight = F.lit(1.0) if weight is None else weight
    parts = None
    for kind, col in lists.items():
        part = fb.select(F.explode(col).alias("path"), weight.alias("w"), F.lit(kind).alias("kind"), F.lit(DELTAS[kind]).alias("d"))
        parts = part if parts is None else parts.unionByName(part)
    gated = parts.groupBy("path", "kind").agg(F.count("*").alias("n"), F.avg("w").alias("w"), F.max("d").alias("d")).where(F.col("n") >= GATE)
    return gated.groupBy("path").agg(F.sum(F.col("d") * F.col("w")).alias("delta"))


def cosine_weight(query: Column, stored: Column) -> Column:
    """1 without a comparable embedding; else the cosine, between 0 and 1."""
    norms = scores.dot(stored, stored) * scores.dot(query, query)
    usable = stored.isNotNull() & (F.size(stored) == F.size(query)) & (norms > 0)
    return F.when(usable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), scores.cosine(query, stored)))).otherwise(1.0)


def past_paths(signals: DataFrame, hash_col: str, order: Sequence[str], paths: str) -> DataFrame:
    """(hash, path): paths of earlier signals with the newest signal's error
    hash. One shuffle by hash; no signals are paired. Empty hashes match none."""
    known = signals.where(F.col(hash_col) != "")
    newest = known.groupBy(F.col(hash_col).alias("h_")).agg(F.max(F.struct(*order)).alias("last_"))
    earlier = known.join(newest, F.col(hash_col) == F.col("h_")).where(F.struct(*order) < F.col("last_"))
    return earlier.select(hash_col, F.explode(paths).alias("path")).distinct()


def prunable(reasons: DataFrame, reason: str = "reason", severities: Sequence[str] = ("missing_file", "renamed")) -> DataFrame:
    """Stale notes that may go; dormant ones never do."""
    return reasons.where(F.col(reason).isin(*severities) & (F.col(reason) != "dormant"))


def invalidated(cache: DataFrame, repo: str | None = None, col: str = "repo") -> DataFrame:
    """A cache without a repository's entries; without any for None."""
    return cache.where(F.lit(False)) if repo is None else cache.where(~F.col(col).eqNullSafe(F.lit(repo)))


def note_search(df: DataFrame, query: str, text: Column, order: Sequence[str], limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows that hold every token of the query, by BM25 over term counts; an
    empty query finds none. Statistics are one-row aggregates joined in."""
    import re

    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not words:
        return df.where(F.lit(False)).withColumn("score", F.lit(0.0))
    held = df.withColumn("words_", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != ""))
    count = lambda w: F.size(F.filter("words_", lambda x: x == w))
    held = held.withColumns({f"tf{i}_": count(w) for i, w in enumerate(words)}).withColumn("len_", F.size("words_")).drop("words_")
    stats = held.agg(F.count("*").alias("n_"), F.avg("len_").alias("mean_"), *[F.count_if(F.col(f"tf{i}_") > 0).alias(f"df{i}_") for i in range(len(words))])
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(words)):
        tf, n = F.col(f"tf{i}_"), F.col(f"df{i}_")
        every = every & (tf > 0)
        idf = F.greatest(F.lit(1e-6), F.ln((F.col("n_") - n + 0.5) / (n + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len_") / F.col("mean_")))
    found = held.join(F.broadcast(stats), how="cross").where(every).withColumn("score", F.round(score, 6))
    return found.orderBy(F.desc("score"), *order).limit(limit).select(*df.columns, "score")
