"""The whole chain from classified candidates to a ranked, budgeted pack."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwright.functions import text as tx
from siftwright.operators import boosts, ranking, retrieval, workspace
from siftwright.operators.graph import staged

#: Budgets by mode, and kinds that a mode guarantees one of.
BUDGETS = {"review": 1500, "implement": 1500, "debug": 2500, "handover": 4000, "minimal": 800}
GUARANTEED = {"review": ("changed_file",), "implement": (), "debug": ("impacted_test",), "handover": ("memory",), "minimal": ()}


def build_pack(df: DataFrame, query: str, mode: str, group: Sequence[str], text: Column, budget: int | None = None) -> DataFrame:
    """(group..., ord, confidence, rank) of the selected candidates.

    Scores are blended and rounded to 6 places, so that every engine orders
    ties alike; then duplicates, floor, budget, and the mode's cutoff. Every
    step is a window or a fold within a group; nothing is collected.
    """
    scored = retrieval.bm25(df, query, text)
    scored = scored.withColumn("confidence", F.round(retrieval.blend(F.col("confidence"), F.col("bm25")), 6)).drop("bm25")
    unique = ranking.dedup(scored, group, [F.col("title"), tx.normal_path(F.col("path"))], hidden=None)
    floored = ranking.score_floor(unique, group, mode)
    chosen = ranking.knapsack(floored, group, budget or BUDGETS[mode], GUARANTEED[mode]).select(*group, "ord")
    kept = floored.join(chosen, [*group, "ord"], "left_semi")
    if mode in ("review", "implement"):
        kept = ranking.adaptive_top_k(kept, group)
    out = ranking.ranked(kept, group)
    return (out.where("rank <= 5") if mode == "minimal" else out).select(*group, "ord", "confidence", "rank")


@dataclass
class Evidence:
    """What a call knows beside its candidates; all of it may be missing.

    ``deltas`` (path, delta) from feedback; ``hubs`` (node, hub) and ``bridges``
    (node, bridge) of the candidates' ``node``; ``changed`` (path, line) of the
    diff, against the candidates' ``line_start`` and ``line_end``; ``files`` (path,
    text) and ``endpoints`` of contracts; whether runtime signals came with it;
    ``discovery`` says whether to look for a source first, whatever the mode.
    """

    deltas: DataFrame | None = None
    hubs: DataFrame | None = None
    bridges: DataFrame | None = None
    changed: DataFrame | None = None
    files: DataFrame | None = None
    endpoints: Sequence[str] = ()
    signals: bool = False
    discovery: bool | None = None


#: Kinds of memory, and modes that look for a source to begin with.
MEMORY = ("memory", "decision")
DISCOVERY = ("implement", "minimal")
#: Share of a budget that memory may take, and items of a minimal pack.
MEMORY_SHARE, MINIMAL_ITEMS = 0.3, 5


def anchored(df: DataFrame, query: str, evidence: Evidence) -> DataFrame:
    """Candidates with what feedback and file names in the query give them."""
    out = boosts.feedback(df, evidence.deltas).select(*df.columns) if evidence.deltas is not None else df
    return out.withColumn("confidence", retrieval.filename_boost(F.col("confidence"), F.col("path"), query))


def scored(df: DataFrame, query: str, mode: str, group: Sequence[str], evidence: Evidence) -> DataFrame:
    """Candidates with the confidence that the mode's signals give them: BM25 over
    names, titles and excerpts, the test penalty, the stem, structure (handover)
    and changed lines (review)."""
    corpus = F.concat_ws(" ", tx.basename(F.col("path")), F.col("title"), F.col("excerpt"))
    out = retrieval.bm25(df, query, corpus)
    out = out.withColumn("confidence", retrieval.blend(F.col("confidence"), F.col("bm25"))).drop("bm25")
    out = boosts.test_penalty(out, group, "confidence", F.col("path"), mode=mode, discovery=discovers(mode, evidence))
    out = out.withColumn("confidence", retrieval.stem_boost(F.col("confidence"), F.col("path"), query))
    if mode == "handover" and evidence.hubs is not None and evidence.bridges is not None:
        out = boosts.hub_bridge(out, evidence.hubs, evidence.bridges)
    if mode == "review" and evidence.changed is not None:
        out = boosts.diff_aware(out, evidence.changed, "ord", "path", "line_start", "line_end").drop("hit")
    return out.withColumn("confidence", F.round("confidence", 6))


def discovers(mode: str, evidence: Evidence) -> bool:
    if evidence.discovery is not None:
        return evidence.discovery
    return mode in DISCOVERY or mode == "debug" and not evidence.signals


def narrowed(df: DataFrame, group: Sequence[str], mode: str, evidence: Evidence) -> DataFrame:
    """One item a file; in discovery, groups with changed files keep only these
    (``only_`` tells them); then the mode's floor, but for memory and such groups."""
    one = ranking.dedup_by_file(ranking.dedup_stubs(df, group), group).drop("duplicates_hidden")
    every = Window.partitionBy(*group)
    only = F.max((F.col("kind") == "changed_file").cast("int")).over(every) == 1 if discovers(mode, evidence) else F.lit(False)
    out = one.withColumn("only_", F.coalesce(only, F.lit(False))).where(~F.col("only_") | (F.col("kind") == "changed_file"))
    free = F.col("only_") | F.col("kind").isin(*MEMORY)
    return out.where(free).unionByName(ranking.score_floor(out.where(~free), group, mode))


def shown(df: DataFrame, group: Sequence[str], mode: str, evidence: Evidence) -> DataFrame:
    """Review, implement and discovery lose their tail of low confidence, unless a
    group shows its changed files only."""
    if mode not in ("review", "implement") and not discovers(mode, evidence):
        return df
    return df.where("only_").unionByName(ranking.adaptive_top_k(df.where("not only_"), group))


def whole_pack(df: DataFrame, query: str, mode: str, group: Sequence[str], evidence: Evidence | None = None, budget: int | None = None, cap: int = -1) -> DataFrame:
    """(group..., ord, confidence, rank, total_tokens) of a mode's pack.

    ``df`` has ord, path, title, excerpt, kind, confidence and est_tokens, and
    what ``evidence`` asks for. Signals come first (``anchored``, ``scored``), then one item a
    file and the floor (``narrowed``), the memory share and the budget, the
    source that discovery pins, the cut of the tail, what consumers of contracts
    gain, review's cut of plain files, the first items of a minimal pack with the
    best code item, and a cap. Every step is a join, a window or a streaming
    fold by group.
    """
    evidence, most = evidence or Evidence(), budget or BUDGETS[mode]
    key = [*group, "ord"]
    pool = staged(narrowed(scored(anchored(df, query, evidence), query, mode, group, evidence), group, mode, evidence))
    chosen = ranking.sub_budget(pool, group, most, MEMORY_SHARE, F.col("kind").isin(*MEMORY), GUARANTEED[mode]).select(*key)
    kept = pool.join(chosen, key, "left_semi")
    if discovers(mode, evidence):
        kept = pool.join(boosts.pinned_source(pool, staged(kept), group, most), key, "left_semi")
    kept = shown(staged(kept), group, mode, evidence)

    def consumers(rows: DataFrame) -> DataFrame:
        if evidence.files is None or not evidence.endpoints:
            return rows
        return boosts.contract_consumers(rows, evidence.files, evidence.endpoints).withColumn("confidence", F.round("confidence", 6))

    kept = staged(consumers(kept))
    if mode == "review":
        kept = kept.join(ranking.tail_cutoff(kept, group, most), key, "left_semi")
    if mode == "minimal":
        first = boosts.pinned_pack(kept, consumers(shown(pool, group, mode, evidence)), group, most=MINIMAL_ITEMS)
        every = consumers(pool).select(*key, "confidence", "est_tokens")
        out = first.join(every, key).withColumn("rank", F.col("slot") + 1).drop("slot")
    else:
        out = ranking.ranked(kept, group)
    out = out if cap < 0 else out.where(F.col("rank") <= cap)
    total = F.sum("est_tokens").over(Window.partitionBy(*group)).cast("long")
    return out.withColumn("total_tokens", total).select(*key, "confidence", "rank", "total_tokens")


def pack_summary(pack: DataFrame, every: DataFrame, group: Sequence[str], tokens: str = "est_tokens") -> DataFrame:
    """(group..., items, tokens, baseline, reduction) of a pack against all
    candidates."""
    got = pack.join(every.select(*group, "ord", tokens), [*group, "ord"]).groupBy(*group).agg(F.count("*").alias("items"), F.sum(tokens).alias("tokens"))
    base = every.groupBy(*group).agg(F.sum(tokens).alias("baseline"))
    both = base.join(got, list(group), "left").na.fill(0, ["items", "tokens"])
    return both.withColumn("reduction", ranking.reduction_pct(F.col("baseline"), F.col("tokens")))


def community_anchor(df: DataFrame, group: Sequence[str], conf: str = "confidence", community: str = "community", ord: str = "ord") -> DataFrame:
    """Rows of the best row's community gain 0.10, up to 1. The best row is the
    first by confidence that has a community."""
    best = df.where(F.col(community).isNotNull()).groupBy(*group).agg(F.min_by(community, F.struct(-F.col(conf), F.col(ord))).alias("anchor_"))
    joined = df.join(best, list(group), "left")
    same = F.coalesce(F.col(community) == F.col("anchor_"), F.lit(False))
    return joined.withColumn(conf, F.when(same, F.least(F.lit(1.0), F.col(conf) + 0.10)).otherwise(F.col(conf))).drop("anchor_")


def external_resolved(stubs: DataFrame, edges: DataFrame) -> DataFrame:
    """(stub, file): stubs that exactly one file refers to, rewritten to it;
    the others are dropped. ``edges`` is (file, stub)."""
    refs = edges.groupBy("stub").agg(F.countDistinct("file").alias("n"), F.min("file").alias("file")).where("n = 1")
    return stubs.join(refs, "stub").select("stub", "file")


def external_dropped(stubs: DataFrame, edges: DataFrame) -> DataFrame:
    """(resolved, dropped): one row, how many stubs have one file that refers to
    them, and how many go."""
    refs = edges.groupBy("stub").agg(F.countDistinct("file").alias("n"))
    n = F.col("n").eqNullSafe(F.lit(1))
    return stubs.join(refs, "stub", "left").agg(F.count_if(n).alias("resolved"), F.count_if(~n).alias("dropped"))


def newest_packs(packs: DataFrame, created: str, ids: str, keep: int = 20) -> DataFrame:
    """A registry bounded to the newest packs."""
    return packs.orderBy(F.desc(created), F.desc(ids)).limit(keep)


def affected_flows(flows: DataFrame, node: int) -> DataFrame:
    return flows.where(F.array_contains("path", node))


def flow_label(items: DataFrame, flows: DataFrame, node: str) -> DataFrame:
    """Each item's shortest flow through its node, ties by entry and leaf."""
    through = flows.select(F.explode(F.array_distinct("path")).alias("n_"), F.size("path").alias("len_"), "entry", "leaf")
    best = through.groupBy("n_").agg(F.min(F.struct("len_", "entry", "leaf")).alias("best_"))
    joined = items.join(best, F.col(node) == F.col("n_"), "left")
    return joined.withColumn("flow", F.when(F.col("best_").isNotNull(), F.concat_ws(">", F.col("best_.entry").cast("string"), F.col("best_.leaf").cast("string")))).drop("n_", "best_")


#: First items of a debug pack that are looked at, and how many of
#: them should have a flow.
FLOW_TOP, FLOW_LEAST = 5, 3


def flow_note(labelled: DataFrame, group: Sequence[str], conf: str = "confidence", ord: str = "ord") -> DataFrame:
    """(group..., note): told where fewer of the first items than wanted have a
    ``flow``, else null."""
    first = ranking.ranked(labelled, group, conf, ord).where(F.col("rank") <= FLOW_TOP)
    told = first.groupBy(*group).agg(F.count(F.nullif(F.col("flow"), F.lit(""))).alias("with_"), F.count("*").alias("n_"))
    text = F.format_string("flows available for only %d of top %d items; consider re-indexing or widening the query", "with_", "n_")
    return told.select(*group, F.when(F.col("with_") < FLOW_LEAST, text).alias("note"))


def workspace_pack(df: DataFrame, query: str, mode: str, linked: DataFrame, producers: DataFrame, evidence: Evidence | None = None, repo: str = "repo", repo_budget: int | None = None, budget: int = 8000) -> DataFrame:
    """(repo, ord, title, confidence, rank, total_tokens, baseline, reduction) over
    several repositories; ``ord`` is unique among all of them.

    Packs of all repositories are made at once, by group. What they select, some
    items each, is labelled and gains by links to and contracts of its repository;
    it is then ranked again as one group, under one budget. ``reduction`` is the
    saving in percent against all candidates of the repositories.
    """
    first = whole_pack(df, query, mode, [repo], evidence, repo_budget).select(repo, "ord", F.col("confidence").alias("first_"))
    chosen = df.join(first, [repo, "ord"]).withColumn("confidence", F.col("first_")).drop("first_")
    items = workspace.merged(workspace.link_boosts(chosen, linked, producers, repo=repo), repo)
    every, plain = ["all_"], Evidence(discovery=False)
    pool = narrowed(scored(items.withColumn("all_", F.lit(1)), query, mode, every, plain), every, mode, plain)
    pool = staged(pool)  # no more rows than the repositories' budgets hold
    kept = pool.join(ranking.sub_budget(pool, every, budget, MEMORY_SHARE, F.col("kind").isin(*MEMORY), GUARANTEED[mode]).select("ord"), "ord", "left_semi")
    second = ranking.ranked(shown(kept, every, mode, plain), every)
    second = second.withColumn("total_tokens", F.sum("est_tokens").over(Window.partitionBy(*every)).cast("long"))
    baseline = df.agg(F.sum("est_tokens").alias("baseline"))
    out = second.join(F.broadcast(baseline), how="cross")  # one row
    reduction = ranking.reduction_pct(F.col("baseline"), F.col("total_tokens"))
    return out.select(repo, "ord", "title", "confidence", "rank", "total_tokens", "baseline", reduction.alias("reduction"))
