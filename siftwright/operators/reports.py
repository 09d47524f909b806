"""What is told about a pack: reasons, next steps, histograms, shares, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwright.functions import text as tx
from siftwright.operators import classify

#: What a category says of a file, and of one of its symbols.
REASONS = {
    "changed_file": "Modified in current diff", "blast_radius": "Depends on or is imported by a changed file", "impacted_test": "Tests code affected by this change",
    "config": "Configuration file touched by change", "entrypoint": "Public API entry point", "contract": "Data contract or interface definition",
    "extension_point": "Plugin or extension point", "query_match": "File or symbol name matches the query", "file": "Referenced in codebase",
    "runtime_signal": "Mentioned in runtime error or stack trace", "failing_test": "Test file likely related to the failure", "memory": "Recorded in session memory",
    "decision": "Architectural decision record", "call_chain": "Reachable via function call chain from error site",
    "blast_radius_transitive": "Transitively reachable via call chain from a changed file",
}
DEFAULT_REASON = "Included in context pack"
SYMBOL_REASONS = {
    "changed_file": "Modified", "blast_radius": "Depends on or is imported by", "blast_radius_transitive": "Transitively reachable via call chain from",
    "impacted_test": "Tests code affected by this change in", "config": "Configuration symbol touched by change in", "entrypoint": "Public API entry point",
    "contract": "Data contract or interface definition", "extension_point": "Plugin or extension point", "query_match": "File or symbol name matches the query",
    "file": "Referenced in codebase", "runtime_signal": "Mentioned in runtime error or stack trace", "failing_test": "Test symbol likely related to the failure",
    "call_chain": "Reachable via function call chain from error site", "past_debug": "Related to a previously debugged failure",
}
#: Suffixes of configuration, and the tokens that a symbol costs a naive reader.
CONFIG = (".yml", ".yaml", ".toml", ".ini", ".json", ".cfg")
NAIVE_OVERHEAD = 40


def looked_up(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def symbol_reason(category: Column, name: Column, first: Column, last: Column) -> Column:
    """``verb `name` lines a-b`` for symbols with valid lines, else empty."""
    verb = looked_up(SYMBOL_REASONS, category)
    good = verb.isNotNull() & (first > 0) & (last >= first) & (F.coalesce(F.length(name), F.lit(0)) > 0)
    return F.when(good, F.format_string("%s `%s` lines %d-%d", verb, name, first, last)).otherwise("")


def reason(given: Column, category: Column) -> Column:
    """A reason that is there stays; else the category's."""
    return F.coalesce(F.nullif(given, F.lit("")), looked_up(REASONS, category), F.lit(DEFAULT_REASON))


def next_tool(df: DataFrame, group: Sequence[str], path: str = "path", conf: str = "confidence", ord: str = "ord") -> DataFrame:
    """(group..., next_tool): debug after a pack that a test leads, review after
    one of configuration for the most part (2 at least), else implement."""
    low = F.lower(F.col("first_"))
    test = F.contains(F.concat(F.lit("/"), low, F.lit("/")), F.lit("/tests/")) | tx.basename(low).startswith("test_") | tx.basename(low).endswith("_test.py")
    config = F.lower(F.regexp_extract(tx.basename(F.col(path)), r".(\.[^.]+)$", 1)).isin(*CONFIG)
    told = df.groupBy(*group).agg(F.min_by(path, F.struct(-F.col(conf), F.col(ord))).alias("first_"), F.count_if(config).alias("config_"), F.count("*").alias("n_"))
    most = F.col("config_") >= F.greatest(F.lit(2), F.floor(F.col("n_") / 2))
    return told.select(*group, F.when(test, "debug").when(most, "review").otherwise("implement").alias("next_tool"))


def histogram(df: DataFrame, group: Sequence[str], value: str, keep: int = 5) -> DataFrame:
    """(group..., value, n): the ``keep`` most frequent values of each group; counts
    are reduced before they are ranked."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), F.asc_nulls_last(value)))
    return counts.withColumn("nth_", nth).where(F.col("nth_") <= keep).drop("nth_")


def budget_breakdown(df: DataFrame, group: Sequence[str], tokens: str = "est_tokens", memory: Column | None = None) -> DataFrame:
    """(group..., total, memory_tokens, memory_ratio to four places)."""
    mem = F.sum(F.when(F.col("kind") == "memory" if memory is None else memory, F.col(tokens)).otherwise(0))
    ratio = F.when(F.sum(tokens) > 0, F.round(mem / F.sum(tokens), 4)).otherwise(0.0)
    return df.groupBy(*group).agg(F.sum(tokens).alias("total"), mem.alias("memory_tokens"), ratio.alias("memory_ratio"))


def provenance_counts(df: DataFrame, group: Sequence[str] = (), provenance: str = "provenance", federated: Column | None = None) -> DataFrame:
    """(group..., committed, staged, federated) of notes; federated ones count as such only."""
    other = F.lit(False) if federated is None else federated
    mine = lambda name: F.count_if(~other & (F.col(provenance) == name))
    return df.groupBy(*group).agg(mine("committed").alias("committed"), mine("staged").alias("staged"), F.count_if(other).alias("federated"))


def naive_tokens(df: DataFrame, group: Sequence[str], text: Column) -> DataFrame:
    """(group..., naive_tokens): what reading every symbol would cost."""
    return df.groupBy(*group).agg(F.sum(tx.token_estimate(text, NAIVE_OVERHEAD)).alias("naive_tokens"))


def members(df: DataFrame, community: str = "community", node: str = "node", shown: int | None = None) -> DataFrame:
    """(community, members, nodes): how many members, and the first ``shown`` of
    them in order, all if None."""
    counts = df.where(F.col(community).isNotNull()).groupBy(community).agg(F.count("*").alias("members"))
    nth = F.row_number().over(Window.partitionBy(community).orderBy(node))
    some = df.where(F.col(community).isNotNull())
    some = some if shown is None else some.withColumn("nth_", nth).where(F.col("nth_") <= shown)
    return counts.join(some.groupBy(community).agg(F.array_sort(F.collect_list(node)).alias("nodes")), community)


def matching(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are among ``wanted``'s, nulls matching nulls."""
    asked = wanted.select(*[F.col(k).alias(f"w{i}_") for i, k in enumerate(keys)]).distinct()
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"w{i}_"))
    return df.join(asked, on, "left_semi")


def edges_from(edges: DataFrame, nodes: DataFrame, end: str = "src") -> DataFrame:
    """Edges whose ``end`` (src or dst) is among ``nodes`` (node)."""
    return edges.join(nodes.select(F.col("node").alias(end)).distinct(), end, "left_semi").select(*edges.columns)


def handover(code: DataFrame, notes: DataFrame, decisions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(part, id, kind, confidence) of the three sources of a handover: code by
    its category, with the prior of changed files; notes by ``score`` up to their
    weight, 0.10 at least; and decisions that none superseded, likewise. ``code``
    has (id, path, changed, blast), the others (id, score), decisions status."""
    w = {**classify.HANDOVER, **(weights or {})}
    category = classify.first_match([("changed_file", F.col("changed")), ("blast_radius", F.col("blast"))], "file")
    rows = code.withColumn("kind", category)
    conf = classify.changed_prior(F.col("kind"), classify.weight_of(F.col("kind"), w), F.col("path"))
    first = rows.select(F.lit("code").alias("part"), F.col("id").cast("string").alias("id"), "kind", F.round(conf, 6).alias("confidence"))

    def fresh(df: DataFrame, kind: str) -> DataFrame:
        score = F.least(F.lit(w[kind]), F.greatest(F.lit(0.10), F.col("score")))
        return df.select(F.lit(kind).alias("part"), F.col("id").cast("string").alias("id"), F.lit(kind).alias("kind"), F.round(score, 6).alias("confidence"))

    return first.unionByName(fresh(notes, "memory")).unionByName(fresh(decisions.where(~F.col("status").eqNullSafe("superseded")), "decision"))
