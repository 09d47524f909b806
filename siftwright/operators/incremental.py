"""What follows an index run, done again only where files have changed.

Components are labels: the least node that can be reached. A change of edges can
only change the labels of nodes in components that lose an edge or a node, or
that a new edge touches. These components' nodes and the new nodes are labelled
anew over their own edges; all other labels stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.operators import graph
from siftwright.operators.graph import staged
from siftwright.operators.workspace import test_links

EDGE = ["src", "dst", "edge_type"]


@dataclass
class Finished:
    """A finished index: ``symbols`` (node, name, kind, path, community),
    ``edges`` (src, dst, edge_type) with test links, ``labels`` (node, component)."""

    symbols: DataFrame
    edges: DataFrame
    labels: DataFrame


def finish(symbols: DataFrame, edges: DataFrame) -> Finished:
    """The whole run: test links, labels, communities."""
    linked = with_links(symbols, edges)
    labels = staged(graph.components(linked, symbols.select("node")).select("node", "component"), large=True)
    return Finished(numbered(symbols, labels), linked, labels)


def with_links(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return staged(edges.select(*EDGE).unionByName(test_links(symbols).withColumn("edge_type", F.lit("tested_by"))).distinct(), large=True)


def numbered(symbols: DataFrame, labels: DataFrame) -> DataFrame:
    """Symbols with the dense number of their component as community."""
    roots = graph.dense_number(labels.select("component").distinct(), "component", "community")
    return graph.write_back(symbols, labels.join(roots, "component").select("node", "community"))


def relabelled(nodes: DataFrame, edges: DataFrame, old: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(node, component) of ``nodes`` over ``edges``, from the labels ``old`` of
    the graph before ``removed`` edges (src, dst) went and ``added`` ones came."""
    ends = removed.select("src", "dst").union(added.select("src", "dst"))
    ends = ends.select(F.col("src").alias("node")).union(ends.select("dst"))
    gone = old.join(nodes, "node", "left_anti").select("node")
    hit = staged(old.join(ends.union(gone).distinct(), "node", "left_semi").select("component").distinct(), large=True)
    kept = old.join(hit, "component", "left_anti").join(nodes, "node", "left_semi").select("node", "component")
    kept = staged(kept, large=True)
    region = staged(nodes.select("node").distinct().join(kept, "node", "left_anti"), large=True)
    inner = edges.join(region.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
    fresh = graph.components(inner, region).select("node", "component")
    return staged(kept.unionByName(fresh), large=True)


def refinish(before: Finished, symbols: DataFrame, edges: DataFrame) -> Finished:
    """The index after files were replaced, from the one before: ``symbols`` and
    ``edges`` are those of the whole index now, edges without test links."""
    linked = with_links(symbols, edges)
    removed, added = before.edges.join(linked, EDGE, "left_anti"), linked.join(before.edges, EDGE, "left_anti")
    labels = relabelled(symbols.select("node"), linked, before.labels, removed, added)
    return Finished(numbered(symbols, labels), linked, labels)


def replace_files(symbols: DataFrame, edges: DataFrame, paths: DataFrame, fresh_symbols: DataFrame, fresh_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges with those of ``paths`` (path) replaced; edges belong to
    the file of their source, and edges into nodes that are gone go too."""
    stay = symbols.join(paths.select("path").distinct(), "path", "left_anti").select(*symbols.columns)
    every = staged(stay.unionByName(fresh_symbols.select(*symbols.columns)), large=True)
    mine = edges.join(stay.select(F.col("node").alias("src")), "src", "left_semi").select(*EDGE).unionByName(fresh_edges.select(*EDGE))
    return every, staged(mine.join(every.select(F.col("node").alias("dst")), "dst", "left_semi").select(*EDGE), large=True)
