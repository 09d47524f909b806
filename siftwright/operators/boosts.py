"""Confidence boosts from structure, changes, contracts and feedback, and caps on
what a pack shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwright.functions import scores
from siftwright.functions import text as tx
from siftwright.operators import graph, ranking, workspace
from siftwright.operators.folds import fold

#: Shares and cap of the hub and bridge boost; other boosts; the
#: confidence of what a call chain of two steps reaches.
HUB, BRIDGE, STRUCTURE = 0.07, 0.05, 0.10
DIFF, CONTRACT, TRANSITIVE = 0.15, 0.10, 0.35
#: Factors of the test penalty, plain and in source discovery, and
#: the share of a test's score that another item must reach.
PENALTY, DISCOVERY_PENALTY, RIVAL = 0.85, 0.65, 0.70
#: Kinds of evidence that are never penalised or pinned, and the
#: kinds that a minimal pack may pin.
EVIDENCE = ("runtime_signal", "failing_test")
OVERLAYS = ("memory", "decision", *EVIDENCE)
CODE_KINDS = ("entrypoint", "contract", "extension_point", "file")


def hub_bridge(items: DataFrame, hubs: DataFrame, bridges: DataFrame, node: str = "node", conf: str = "confidence") -> DataFrame:
    """Items gain by the hub and bridge scores of their node, 0.10 at most.
    ``hubs`` is (node, hub), ``bridges`` (node, bridge)."""
    h = hubs.select(F.col("node").alias("h_"), "hub")
    b = bridges.select(F.col("node").alias("b_"), "bridge")
    joined = items.join(h, F.col(node) == F.col("h_"), "left").join(b, F.col(node) == F.col("b_"), "left")
    zero = F.lit(0.0)
    gain = F.least(F.lit(STRUCTURE), HUB * F.coalesce("hub", zero) + BRIDGE * F.coalesce("bridge", zero))
    return joined.withColumn(conf, F.when(gain > 0, scores.capped(F.col(conf) + gain)).otherwise(F.col(conf))).select(*items.columns)


def diff_aware(items: DataFrame, changed: DataFrame, key: str, path: str, start: str, end: str, conf: str = "confidence") -> DataFrame:
    """Items whose lines hold a changed line gain 0.15; ``hit`` tells which."""
    hits = workspace.diff_overlap(items.select(key, path, start, end), changed, path, start, end).select(F.col(key).alias("k_")).distinct()
    joined = items.join(hits, F.col(key) == F.col("k_"), "left").withColumn("hit", F.col("k_").isNotNull())
    return joined.withColumn(conf, F.when(F.col("hit"), scores.capped(F.col(conf) + DIFF)).otherwise(F.col(conf))).drop("k_")


def contract_consumers(items: DataFrame, files: DataFrame, endpoints: Sequence[str], path: str = "path", text: str = "text", conf: str = "confidence", head: int = 256 * 1024) -> DataFrame:
    """Items of files that quote any endpoint in their first ``head`` characters
    gain 0.10. ``files`` is (path, text); a file is read once."""
    hit = F.lit(False)
    for e in endpoints:
        hit = hit | F.rlike(F.substring(F.col(text), 1, head), F.lit(tx.endpoint_pattern(e)))
    users = files.where(hit).select(F.col(path).alias("u_")).distinct()
    joined = items.join(users, F.col(path) == F.col("u_"), "left")
    return joined.withColumn(conf, F.when(F.col("u_").isNotNull(), scores.capped(F.col(conf) + CONTRACT)).otherwise(F.col(conf))).drop("u_")


def feedback(items: DataFrame, deltas: DataFrame, path: str = "path", conf: str = "confidence") -> DataFrame:
    """Add each path's feedback delta, between 0 and 0.95. Items without one
    keep their confidence."""
    d = deltas.select(F.col("path").alias("d_"), F.col("delta").alias("delta_"))
    joined = items.join(d, F.col(path) == F.col("d_"), "left")
    moved = F.greatest(F.lit(0.0), scores.capped(F.col(conf) + F.col("delta_")))
    return joined.withColumn(conf, F.when(F.col("delta_").isNotNull(), moved).otherwise(F.col(conf))).drop("d_", "delta_")


def transitive_blast(calls: DataFrame, nodes: DataFrame, changed: DataFrame, near: DataFrame) -> DataFrame:
    """(file, confidence): files that a call chain of at most two steps reaches
    from a changed file, beyond changed files and their neighbours ``near``.
    ``calls`` is (src, dst), ``nodes`` (node, file), the others (file)."""
    start = nodes.join(changed.select("file").distinct(), "file", "left_semi").select("node")
    one = calls.join(start, calls["src"] == start["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
    two = calls.join(one, calls["src"] == one["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
    files = nodes.join(one.union(two).distinct(), "node", "left_semi").select("file").distinct()
    out = files.join(changed.select("file").union(near.select("file")), "file", "left_anti")
    return out.withColumn("confidence", F.lit(TRANSITIVE))


def test_penalty(df: DataFrame, group: Sequence[str], conf: str, path: Column, kind: str = "kind", mode: str = "review", discovery: bool = False) -> DataFrame:
    """Tests and scripts lose a share of their score where the best other item of
    the group has at least 0.7 of it; not in debug mode, and never evidence."""
    test = tx.is_test_path(path)
    if mode == "debug" and not discovery:
        return df
    best = F.coalesce(F.max(F.when(~test, F.col(conf))).over(Window.partitionBy(*group)), F.lit(0.0))
    out = df.withColumn("best_", best)
    falls = test & ~F.col(kind).isin(*EVIDENCE) & (F.col("best_") >= RIVAL * F.col(conf))
    factor = DISCOVERY_PENALTY if discovery else PENALTY
    return out.withColumn(conf, F.when(falls, F.col(conf) * factor).otherwise(F.col(conf))).drop("best_")


def review_candidates(symbols: DataFrame, edges: DataFrame, changed: DataFrame, tests: Column, config: Column, matched: Column, path: str = "path") -> DataFrame:
    """``symbols`` (node, path, ...) with ``category``: files changed, one edge
    from a changed file, tests of one, configuration, or matched by the query.
    ``edges`` is (src, dst) over nodes; ``changed`` (path)."""
    from siftwright.operators import classify

    files = symbols.select("node", F.col(path).alias("f_"))
    touched = changed.select(F.col("path").alias("c_")).distinct()
    ends = edges.join(files.select(F.col("node").alias("s_"), F.col("f_").alias("fs_")), F.col("src") == F.col("s_"))
    ends = ends.join(files.select(F.col("node").alias("d_"), F.col("f_").alias("fd_")), F.col("dst") == F.col("d_")).where("fs_ <> fd_").select("fs_", "fd_").distinct()
    both = ends.select(F.col("fs_").alias("c_"), F.col("fd_").alias("n_")).union(ends.select("fd_", "fs_"))
    near = both.join(touched, "c_", "left_semi").select("n_").distinct()
    stems = changed.select(tx.stem(F.col("path")).alias("t_")).distinct()
    out = symbols.join(touched, F.col(path) == F.col("c_"), "left").join(near, F.col(path) == F.col("n_"), "left")
    out = out.join(stems, tests & (tx.tested_stem(F.col(path)) == F.col("t_")), "left")
    category = classify.review(F.col("c_").isNotNull(), F.col("n_").isNotNull(), F.col("t_").isNotNull(), config, matched)
    return out.withColumn("category", category).drop("c_", "n_", "t_")


def top_k(df: DataFrame, group: Sequence[str], k: int, conf: str = "confidence", tokens: str = "est_tokens", ord: str = "ord") -> DataFrame:
    """The first ``k`` rows of each group, all if negative, with ``total_tokens``
    of what is left."""
    out = ranking.ranked(df, group, conf, ord)
    out = out if k < 0 else out.where(F.col("rank") <= k)
    return out.withColumn("total_tokens", F.sum(tokens).over(Window.partitionBy(*group)).cast("long"))


def pinned_pack(page: DataFrame, pool: DataFrame, group: Sequence[str], key: Sequence[str] = ("path", "title"), most: int = 5, kind: str = "kind", conf: str = "confidence", ord: str = "ord") -> DataFrame:
    """The page's first ``most`` rows with the pool's best code item in slot 0,
    whether the page has it or not. Returns (group..., ord, slot)."""
    first = Window.partitionBy(*group).orderBy(*ranking.by_conf(conf, ord))
    cols = [*group, *key, conf, ord]
    code = pool.where(F.col(kind).isin(*CODE_KINDS)).select(*cols, F.row_number().over(first).alias("nth_")).where("nth_ = 1").drop("nth_")
    capped = page.select(*cols, F.row_number().over(first).alias("nth_")).where(F.col("nth_") <= most)
    rest = capped.join(code.select(*group, *key), [*group, *key], "left_anti")
    every = code.withColumn("nth_", F.lit(0)).unionByName(rest)
    slot = F.row_number().over(Window.partitionBy(*group).orderBy("nth_")) - 1
    return every.select(*group, ord, slot.alias("slot")).where(F.col("slot") < most)


def pinned_source(df: DataFrame, selected: DataFrame, group: Sequence[str], budget: int, path: str = "path", kind: str = "kind", conf: str = "confidence", tokens: str = "est_tokens", ord: str = "ord") -> DataFrame:
    """Source discovery: the first item of ``df`` that is neither a test nor an
    overlay enters ``selected`` even over budget, and the others are refilled
    after it as they fit, best first. Groups whose selection has its path stay
    as they are. Returns (group..., ord)."""
    best = Window.partitionBy(*group).orderBy(*ranking.by_conf(conf, ord))
    source = df.where(~F.col(kind).isin(*OVERLAYS) & ~tx.is_test_path(F.col(path)))
    pin = source.withColumn("nth_", F.row_number().over(best)).where("nth_ = 1").drop("nth_")
    there = selected.join(pin.select(*group, path), [*group, path], "left_semi").select(*group).distinct()
    pin = pin.join(there, list(group), "left_anti")
    both = pin.withColumn("pin_", F.lit(True)).unionByName(selected.withColumn("pin_", F.lit(False)), allowMissingColumns=True)

    def step(state: list, row: tuple) -> tuple | None:
        ord_, size, pinned = row
        if not state:  # the pin comes first, if there is one
            state += [0, pinned]
        if state[1] and not pinned and (size is None or state[0] + size > budget):
            return None
        state[0] += size or 0
        return (ord_,)

    inputs = {"ord": F.col(ord).cast("long"), "tokens": F.col(tokens).cast("long"), "pin": F.col("pin_")}
    return fold(both, group, [~F.col("pin_"), -F.col(conf), F.col(ord)], inputs, list, step, {ord: "bigint"})


def majority(df: DataFrame, group: Sequence[str], value: str, ord: str = "ord") -> DataFrame:
    """(group..., value): the most frequent value, the first seen of equals;
    null and empty count as "default"."""
    named = df.withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.lit("default")))
    counts = named.groupBy(*group, value).agg(F.count("*").alias("n_"), F.min(ord).alias("first_"))
    return counts.groupBy(*group).agg(F.max_by(value, F.struct("n_", -F.col("first_"))).alias(value))


def gated_hotspots(edges: DataFrame, names: DataFrame, **kw) -> DataFrame:
    """Untested hotspots, none where no ``tested_by`` edge exists at all."""
    spots = graph.untested_hotspots(edges, names, **kw)
    return spots.join(F.broadcast(edges.where("edge_type = 'tested_by'").limit(1).select(F.lit(1).alias("gate_"))), how="cross").drop("gate_")


def signal_nodes(nodes: DataFrame, kind: str = "kind") -> DataFrame:
    """Nodes for a graph export: no stubs, files or imports."""
    return nodes.where(~F.col(kind).isin("external", "file", "import"))


def capped_with_missing(table: DataFrame, wanted: DataFrame, limit: int, order: Sequence[str], path: str = "path") -> DataFrame:
    """The first ``limit`` rows, and all rows of wanted paths that these lack."""
    head = table.orderBy(*order).limit(limit)
    lacking = wanted.select(path).distinct().join(head.select(path).distinct(), path, "left_anti")
    return head.unionByName(table.join(lacking, path, "left_semi"))
