"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two equi-joins; lineage is cut by a table in
the shared folder, so a lost executor costs one round at most. Aggregations
combine before they shuffle, and the joins are plain equi-joins, whose hot keys
(the centre of a large star) adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import staged, unstage


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has two integer columns; returns (node, component): the least
    node reachable, for every node that has an edge. Self-loops, repeated edges
    and nulls are ignored."""
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = staged(e.where("u <> v and u is not null and v is not null").distinct(), "edges")
    last = _signature(e)
    while last[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
            e.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")).withColumnRenamed("x", "x2")
        large = (
            both.where("y > x").join(least, F.col("x") == F.col("x2"))
            .select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = staged(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = least.select("u", F.col("m").alias("v"))
        other = least.withColumnRenamed("u", "u2")
        moved = (
            large.join(other, F.col("u") == F.col("u2"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        )
        used, e = e, staged(kept.union(moved).distinct(), "small")
        unstage(used)
        unstage(large)
        now = _signature(e)
        if now == last:
            break
        last = now
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.union(roots)


class Forest:
    """Union-find over 0..n-1 for what one task sees; ``edges`` yields a
    spanning forest, a row for each element that is not its own root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def edges(self):
        for i in range(len(self.parent)):
            root = self.find(i)
            if root != i:
                yield i, root
