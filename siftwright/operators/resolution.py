"""Edges by name resolved to nodes, by lookups that are reduced first.

An endpoint is a name seen from a file. Several symbols may have the name; which
one is meant follows from tiers: for inheritance and test edges a source is a
class in the file, then a class anywhere, and then, as for all other endpoints,
any symbol of the file, the first symbol of the file that the name is the path
of (sources only), and any symbol of the repository. Each tier's best candidate
per name is found by one aggregation of the symbols; the edges' different
endpoints, not the edges, meet these tables, one row each. So a name with many
candidates pairs with none of its edges' rows.

Targets of inheritance that nothing has become stubs of kind ``external``, one a
name and repository; other edges without a source or target are dropped and
reported with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that can have heirs, edge types whose source is such a kind,
#: and those whose targets may be external; order of kinds among equal names.
CLASS_KINDS = ("class", "record", "interface", "enum", "struct")
CLASS_SOURCES, INHERITANCE = ("extends", "implements", "tested_by"), ("extends", "implements")
FIRST_KINDS = ("class", "function")


@dataclass
class Resolved:
    """``edges`` (edge_id, repo, src, dst, edge_type, src_tier, dst_tier),
    ``stubs`` (node, repo, name, kind), ``dropped`` (edge_id, reason)."""

    edges: DataFrame
    stubs: DataFrame
    dropped: DataFrame


def stub_id(repo: Column, name: Column) -> Column:
    """A negative id, as nodes of the index have positive ones."""
    return -F.abs(F.xxhash64(repo, name) % (1 << 62)) - 1


def endpoints(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, file, name, in_file, class_in_file, anywhere, class_anywhere,
    of_file) of the different endpoints of ``edges``."""
    ends = edges.select("repo", "file", F.col("from_symbol").alias("name")).union(edges.select("repo", "file", "to_symbol")).where("name is not null").distinct()
    classy = F.col("kind").isin(*CLASS_KINDS)
    rank = F.when(F.col("kind") == FIRST_KINDS[0], 0).when(F.col("kind") == FIRST_KINDS[1], 1).otherwise(2)
    local = symbols.groupBy(F.col("repo").alias("r1"), F.col("path").alias("p1"), F.col("name").alias("n1")).agg(
        F.max("node").alias("in_file"), F.max(F.when(classy, F.col("node"))).alias("class_in_file")  # the last one of a file counts
    )
    wide = symbols.groupBy(F.col("repo").alias("r2"), F.col("name").alias("n2")).agg(
        F.min_by("node", F.struct(rank, "node")).alias("anywhere"), F.min(F.when(classy, F.col("node"))).alias("class_anywhere")
    )
    first = symbols.groupBy(F.col("repo").alias("r3"), F.col("path").alias("p3")).agg(F.min_by("node", F.struct("line_start", "node")).alias("of_file"))
    out = ends.join(local, (F.col("repo") == F.col("r1")) & (F.col("file") == F.col("p1")) & (F.col("name") == F.col("n1")), "left")
    out = out.join(wide, (F.col("repo") == F.col("r2")) & (F.col("name") == F.col("n2")), "left")
    path = F.when(F.rlike("name", F.lit(r"[/\\]")), F.col("name"))
    out = out.join(first, (F.col("repo") == F.col("r3")) & (path == F.col("p3")), "left")
    return out.select("repo", "file", "name", "in_file", "class_in_file", "anywhere", "class_anywhere", "of_file")


def first_of(row: str, tiers: list[str], when: Column | None = None, more: list[str] = ()) -> tuple[Column, Column]:
    """(node, name of the tier) of the first tier that has one; ``more`` tiers
    come first where ``when`` holds."""
    picks = [(F.when(when, F.col(f"{row}.{t}")), t) for t in more] + [(F.col(f"{row}.{t}"), t) for t in tiers]
    return F.coalesce(*[c for c, _ in picks]), F.coalesce(*[F.when(c.isNotNull(), F.lit(t)) for c, t in picks])


def resolve_edges(edges: DataFrame, symbols: DataFrame) -> Resolved:
    """``edges`` is (edge_id, repo, file, from_symbol, to_symbol, edge_type),
    ``symbols`` (node, repo, path, name, kind, line_start)."""
    from siftwright.operators.graph import staged

    known = staged(endpoints(edges, symbols))

    def seen(name: str) -> DataFrame:
        return known.select(F.col("repo").alias(f"{name}_repo"), F.col("file").alias(f"{name}_file"), F.col("name").alias(f"{name}_name"), F.struct("in_file", "class_in_file", "anywhere", "class_anywhere", "of_file").alias(name))

    rows = edges
    for name, column in (("source", "from_symbol"), ("target", "to_symbol")):
        on = (F.col("repo") == F.col(f"{name}_repo")) & (F.col("file") == F.col(f"{name}_file")) & (F.col(column) == F.col(f"{name}_name"))
        rows = rows.join(seen(name), on, "left")
    strict = F.col("edge_type").isin(*CLASS_SOURCES)
    src, src_tier = first_of("source", ["in_file", "of_file", "anywhere"], strict, ["class_in_file", "class_anywhere"])
    dst, dst_tier = first_of("target", ["in_file", "anywhere"])
    outside = dst.isNull() & F.col("edge_type").isin(*INHERITANCE) & F.col("to_symbol").isNotNull()
    rows = rows.select(
        "edge_id", "repo", "edge_type", "to_symbol", src.alias("src"), src_tier.alias("src_tier"), outside.alias("outside"),
        F.when(outside, stub_id(F.col("repo"), F.col("to_symbol"))).otherwise(dst).alias("dst"), F.when(outside, "external").otherwise(dst_tier).alias("dst_tier"),
    )
    rows = staged(rows)
    whole = rows.where("src is not null and dst is not null")
    stubs = rows.where("outside").select(F.col("dst").alias("node"), "repo", F.col("to_symbol").alias("name"), F.lit("external").alias("kind")).distinct()
    reason = F.when(F.col("src").isNull() & F.col("dst").isNull(), "neither").when(F.col("src").isNull(), "source").otherwise("target")
    dropped = rows.where("src is null or dst is null").select("edge_id", reason.alias("reason"))
    return Resolved(whole.select("edge_id", "repo", "src", "dst", "edge_type", "src_tier", "dst_tier"), stubs, dropped)
