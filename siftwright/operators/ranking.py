"""Ordering, duplicate collapsing, floors, budgets and cutoffs.

Candidates carry ``ord``, the order that breaks ties. Windows are partitioned
by the caller's group (a query, a repository), so groups run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwright.functions import text as tx
from siftwright.operators.folds import fold

#: Floors by mode and source types that a budget guarantees.
FLOORS = {"review": (0.55, 0.30), "implement": (0.55, 0.30), "minimal": (0.55, 0.30), "debug": (0.0, 0.30), "handover": (0.0, 0.20)}
STRUCTURAL = ("changed_file", "blast_radius", "config")


def by_conf(conf: str = "confidence", ord: str = "ord") -> list[Column]:
    return [F.desc(conf), F.asc(ord)]


def ranked(df: DataFrame, group: Sequence[str], conf: str = "confidence", ord: str = "ord") -> DataFrame:
    """Add ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by_conf(conf, ord))))


def dedup(df: DataFrame, group: Sequence[str], key: Sequence[Column], hidden: str | None = "duplicates_hidden", conf: str = "confidence", ord: str = "ord") -> DataFrame:
    """The best row of each key, with the number of the others."""
    keyed = df.withColumn("key_", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))
    over = Window.partitionBy(*group, "key_")
    out = keyed.withColumn("nth_", F.row_number().over(over.orderBy(*by_conf(conf, ord))))
    if hidden:
        out = out.withColumn(hidden, (F.count("*").over(over) - 1).cast("long"))
    return out.where("nth_ = 1").drop("nth_", "key_")


def dedup_ranked(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return dedup(df, group, [F.col("title"), tx.normal_path(F.col("path"))])


def dedup_stubs(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return dedup(df, group, [tx.normal_path(F.col("path")), F.substring_index("title", "(", 1), F.col("excerpt")])


def dedup_by_file(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return dedup(df, group, [tx.normal_path(F.col("path"))])


def score_floor(df: DataFrame, group: Sequence[str], mode: str = "review", conf: str = "confidence", ord: str = "ord") -> DataFrame:
    """Drop what is below the mode's floor; the best row always stays."""
    share, least = FLOORS[mode]
    top = F.max(conf).over(Window.partitionBy(*group))
    floor = F.greatest(F.lit(share) * top, F.lit(least)) - 1e-9
    out = ranked(df, group, conf, ord).withColumn("floor_", floor)
    return out.where((F.col(conf) >= F.col("floor_")) | (F.col("rank") == 1)).drop("floor_", "rank")


def knapsack(df: DataFrame, group: Sequence[str], budget: int, guaranteed: Sequence[str] = (), conf: str = "confidence", tokens: str = "est_tokens", kind: str = "kind", ord: str = "ord") -> DataFrame:
    """Greedy selection by confidence per token: a row is admitted if it fits or
    is the first of a guaranteed kind. Returns (group..., ord) of admitted rows
    and the tokens used before each. Rows without tokens never fit, and cost
    nothing where their kind is guaranteed. Rows that can't be admitted at all
    stay out of the shuffle."""
    sure = frozenset(guaranteed)

    def step(state: list, row: tuple) -> tuple | None:
        used, seen = state
        ord_, size, kind_ = row
        first = kind_ in sure and kind_ not in seen
        if not first and (size is None or used + size > budget):
            return None
        seen.add(kind_)
        state[0] = used + (size or 0)
        return ord_, used

    able = (F.col(tokens) <= budget) | (F.col(kind).isin(*sure) if sure else F.lit(False))
    inputs = {"ord": F.col(ord).cast("long"), "tokens": F.col(tokens).cast("long"), "kind": F.col(kind)}
    return fold(df.where(able), group, by_value(conf, tokens, ord), inputs, lambda: [0, set()], step, {ord: "bigint", "used_before": "bigint"})


def by_value(conf: str, tokens: str, ord: str) -> list[Column]:
    """Best confidence per token first."""
    return [-(F.col(conf) / F.greatest(F.lit(1), F.col(tokens))), -F.col(conf), F.col(ord)]


def sub_budget(df: DataFrame, group: Sequence[str], budget: int, share: float, memory: Column, guaranteed: Sequence[str] = (), conf: str = "confidence", tokens: str = "est_tokens", kind: str = "kind", ord: str = "ord") -> DataFrame:
    """Memory rows get at most a share of the budget, the others what is left:
    one fold, memory rows first, against their own cap. The first row of a
    guaranteed kind is admitted in either part."""
    cap, sure = int(budget * share), frozenset(guaranteed)

    def step(state: list, row: tuple) -> tuple | None:
        ord_, size, kind_, mem = row
        part = 0 if mem else 1
        used, seen = state[part], state[2 + part]
        most = cap if mem else max(0, budget - state[0])
        first = kind_ in sure and kind_ not in seen
        if not first and (size is None or used + size > most):
            return None
        seen.add(kind_)
        state[part] = used + (size or 0)
        return ord_, used, "memory" if mem else "code"

    inputs = {"ord": F.col(ord).cast("long"), "tokens": F.col(tokens).cast("long"), "kind": F.col(kind), "memory": memory}
    order = [~memory, *by_value(conf, tokens, ord)]
    return fold(df.where(memory.isNotNull()), group, order, inputs, lambda: [0, 0, set(), set()], step, {ord: "bigint", "used_before": "bigint", "part": "string"})


def adaptive_top_k(df: DataFrame, group: Sequence[str], conf: str = "confidence", ord: str = "ord") -> DataFrame:
    """Cut the tail below 0.6 of the best; and, where the best exceeds 0.4, from
    the first row below 0.4 that lies within 0.02 of the one before it."""
    over = Window.partitionBy(*group).orderBy(*by_conf(conf, ord))
    every = Window.partitionBy(*group)
    out = df.withColumn("rank", F.row_number().over(over)).withColumn("prev_", F.lag(conf).over(over)).withColumn("top_", F.max(conf).over(every))
    flat = (F.col("top_") > 0.4) & (F.col(conf) < 0.4) & (F.col("prev_") - F.col(conf) < 0.02)
    out = out.withColumn("cut_", F.min(F.when(flat, F.col("rank"))).over(every))
    kept = out.where((F.col(conf) >= 0.6 * F.col("top_")) & (F.col("cut_").isNull() | (F.col("rank") < F.col("cut_"))))
    return kept.drop("prev_", "top_", "cut_", "rank")


def tail_cutoff(df: DataFrame, group: Sequence[str], budget: int, conf: str = "confidence", tokens: str = "est_tokens", kind: str = "kind", ord: str = "ord") -> DataFrame:
    """Once kept rows have used 75 % of the budget, ``file`` rows below 0.4 go.
    The running sum is over kept rows, hence a fold."""

    def step(state: list, row: tuple) -> tuple | None:
        ord_, size, kind_, confidence = row
        if state[0] >= 0.75 * budget and kind_ == "file" and confidence is not None and confidence < 0.4:
            return None
        state[0] += size or 0
        return (ord_,)

    inputs = {"ord": F.col(ord).cast("long"), "tokens": F.col(tokens).cast("long"), "kind": F.col(kind), "confidence": F.col(conf).cast("double")}
    return fold(df, group, [-F.col(conf), F.col(ord)], inputs, lambda: [0], step, {ord: "bigint"})


def paginate(df: DataFrame, group: Sequence[str], page: int, size: int, conf: str = "confidence", ord: str = "ord") -> DataFrame:
    """One page (from 1) with ``total`` and ``has_more``."""
    out = ranked(df, group, conf, ord).withColumn("total", F.count("*").over(Window.partitionBy(*group)))
    out = out.withColumn("has_more", F.col("total") > page * size)
    return out.where((F.col("rank") > (page - 1) * size) & (F.col("rank") <= page * size))


def pinned_minimal(df: DataFrame, group: Sequence[str], code: Column, most: int = 5, conf: str = "confidence", ord: str = "ord") -> DataFrame:
    """The best code row first, then the best others, ``most`` in all."""
    best = F.row_number().over(Window.partitionBy(*group).orderBy(F.when(code, 0).otherwise(1), *by_conf(conf, ord)))
    out = df.withColumn("pin_", F.when((best == 1) & code, 0).otherwise(1))
    slot = F.row_number().over(Window.partitionBy(*group).orderBy("pin_", *by_conf(conf, ord)))
    return out.withColumn("slot", slot - 1).where(F.col("slot") < most).drop("pin_")


def discovery(df: DataFrame, group: Sequence[str], kind: str = "kind") -> DataFrame:
    """Only changed files, in groups that have any."""
    some = F.max((F.col(kind) == "changed_file").cast("int")).over(Window.partitionBy(*group))
    return df.withColumn("some_", some).where((F.col("some_") == 0) | (F.col(kind) == "changed_file")).drop("some_")


def reduction_pct(baseline: Column, kept: Column) -> Column:
    return F.when(baseline == 0, 0.0).otherwise(F.round(100.0 * (baseline - kept) / baseline, 1))
