"""Exact near-duplicate vectors by cover-tree dual traversal.

Only vectors of one label and dimension are compared. Equal vectors become one
weighted point. The top of the cover tree is a set of centres per label, chosen
from a bounded sample; a point lives in the cell of its nearest centre and also
visits every later cell whose centre is no farther than the cell's covering
radius plus the link distance (triangle bound), so each pair meets exactly once.
Only the balance of the cells depends on the sample. In a cell, points form
nested levels with halving radii, and pairs of nodes are traversed together:
a pair too far apart for its covering radii is pruned, a pair close enough is
linked whole (by weights, without listing its pairs), others go down a level.
A cell sends on a count per point and a spanning forest.

Vectors that are null, zero, or hold null or non-finite components, and rows
with a null label or id, link with nothing: n_links 0, own component (null for
a null id). Repeated rows are equal vectors. An empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import staged, table
from siftwright.llm.components import Forest, components

COSINE = 0.93
#: Points aimed at in a cell; sampled points per centre, and in all at most.
CELL, SAMPLE_PER_CENTRE, SAMPLE = 4_096, 8, 20_000
#: Rounding margin of the bounds, and rows of a block of distances when
#: traversing and when building; pairs of points of two nodes that are compared
#: at once rather than by going further down.
MARGIN, BLOCK, BLOCK_ROWS, SMALL = 1e-7, 2_048, 128, 4_096
SEED = 42


class CoverTree:
    """Levels with halving radii over unit vectors; ``nodes`` holds (centre,
    covering radius, members, children, weight)."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, least: float):
        self.points, self.weights, self.least = points, weights, least
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(points)), 2.0) if len(points) else None

    def _grow(self, members: np.ndarray, radius: float) -> int:
        """Children are found before their parent; recursion is as deep as
        there are levels. Distances come from blocks of dot products: on unit
        vectors d <= r where the product is 1 - r * r / 2 or more."""
        own = self.points[members]
        rho = math.sqrt(max(0.0, 2 - 2 * float((own @ own[0]).min()))) if len(members) > 1 else 0.0
        while radius / 2 >= rho and radius > self.least:
            radius /= 2
        children = []
        if len(members) > 1 and rho > self.least:
            near_dot, alive = 1 - radius * radius / 8, np.ones(len(members), bool)
            while len(left := np.flatnonzero(alive)[:BLOCK_ROWS]):
                for i, dots in zip(left, own[left] @ own.T):
                    if alive[i]:
                        near = alive & (dots >= near_dot)
                        near[i] = True
                        alive &= ~near
                        inside = np.concatenate([[i], np.flatnonzero(near[:i]), i + 1 + np.flatnonzero(near[i + 1 :])])
                        children.append(self._grow(members[inside], radius / 2))
        self.nodes.append((members[0], rho, members, children, float(self.weights[members].sum())))
        return len(self.nodes) - 1


class Links:
    """Counts and forest of the links between two trees (or within one)."""

    def __init__(self, a: CoverTree, b: CoverTree, shift: int, forest: Forest, cosine: float):
        self.a, self.b, self.shift, self.forest, self.cosine = a, b, shift, forest, cosine
        self.reach = math.sqrt(max(0.0, 2 - 2 * cosine))
        self.count_a, self.count_b = np.zeros(len(a.points)), np.zeros(len(b.points))

    def _all(self, m: np.ndarray, n: np.ndarray, own: bool) -> None:
        """Every member of m links with every one of n."""
        if own:
            total = self.a.weights[m].sum()
            self.count_a[m] += total - self.a.weights[m]
        else:
            self.count_a[m] += self.b.weights[n].sum()
            self.count_b[n] += self.a.weights[m].sum()
        for i in m.tolist():
            self.forest.join(i, int(n[0]) + self.shift)
        for j in n.tolist():
            self.forest.join(int(m[0]), j + self.shift)

    def _pairs(self, m: np.ndarray, n: np.ndarray, own: bool) -> None:
        for low in range(0, len(m), BLOCK):
            rows = m[low : low + BLOCK]
            for other in range(low if own else 0, len(n), BLOCK):
                cols = n[other : other + BLOCK]
                hit = self.a.points[rows] @ self.b.points[cols].T >= self.cosine
                if own and low == other:
                    hit = np.triu(hit, 1)
                if not hit.any():
                    continue
                i, j = np.nonzero(hit)
                i, j = rows[i], cols[j]
                np.add.at(self.count_a, i, self.b.weights[j])
                np.add.at(self.count_a if own else self.count_b, j, self.a.weights[i])
                for x, y in zip(i.tolist(), j.tolist()):
                    self.forest.join(x, y + self.shift)

    def run(self) -> None:
        own = self.a is self.b
        if self.a.root is None or self.b.root is None:
            return
        kx, ky = self._start([self.a.root], [self.b.root], own)
        stack = [(k, k) for k in kx if len(self.a.nodes[k][2]) > 1] if own else []
        stack += self._close(kx, ky, own)
        while stack:
            x, y = stack.pop()
            cx, rx, mx, kx, _ = self.a.nodes[x]
            cy, ry, my, ky, _ = self.b.nodes[y]
            same = own and x == y
            if same:
                if len(mx) == 1:
                    continue
                if 2 * rx <= self.reach - MARGIN:
                    self._all(mx, mx, True)
                elif not kx:
                    self._pairs(mx, mx, True)
                else:
                    stack += [(k, k) for k in kx if len(self.a.nodes[k][2]) > 1]
                    stack += self._close(kx, kx, True)
                continue
            diff = self.a.points[cx] - self.b.points[cy]
            d = math.sqrt(float(diff @ diff))
            if d > self.reach + rx + ry + MARGIN:
                continue
            if d + rx + ry <= self.reach - MARGIN:
                self._all(mx, my, False) if not own else self._cross(mx, my)
            elif (not kx and not ky) or len(mx) * len(my) <= SMALL:
                self._pairs(mx, my, False) if not own else self._cross_pairs(mx, my)
            else:
                stack += self._close(kx or [x], ky or [y], False)

    def _cross(self, m: np.ndarray, n: np.ndarray) -> None:
        """Two different nodes of one tree, linked whole."""
        self.count_a[m] += self.a.weights[n].sum()
        self.count_a[n] += self.a.weights[m].sum()
        for i in m.tolist():
            self.forest.join(i, int(n[0]))
        for j in n.tolist():
            self.forest.join(int(m[0]), j)

    def _cross_pairs(self, m: np.ndarray, n: np.ndarray) -> None:
        for low in range(0, len(m), BLOCK):
            for other in range(0, len(n), BLOCK):
                rows, cols = m[low : low + BLOCK], n[other : other + BLOCK]
                hit = self.a.points[rows] @ self.a.points[cols].T >= self.cosine
                if not hit.any():
                    continue
                i, j = np.nonzero(hit)
                i, j = rows[i], cols[j]
                np.add.at(self.count_a, i, self.a.weights[j])
                np.add.at(self.count_a, j, self.a.weights[i])
                for x, y in zip(i.tolist(), j.tolist()):
                    self.forest.join(x, y)

    def _start(self, kx: list[int], ky: list[int], own: bool) -> tuple[list[int], list[int]]:
        """The first level whose bounds rule out most pairs of a few nodes;
        above it, going down pair by pair would only open every pair."""
        while True:
            few = [np.array(k)[:: max(1, len(k) // 64)] for k in (kx, ky)]
            (cx, rx), (cy, ry) = (
                (np.array([t.nodes[k][0] for k in f]), np.array([t.nodes[k][1] for k in f])) for t, f in zip((self.a, self.b), few)
            )
            most = self.reach + rx[:, None] + ry[None, :] + MARGIN
            keep = 2 - 2 * self.a.points[cx] @ self.b.points[cy].T <= most * most
            down = [[c for k in ks for c in (t.nodes[k][3] or [k])] for t, ks in ((self.a, kx), (self.b, ky))]
            if keep.mean() <= 0.1 or (len(down[0]) == len(kx) and len(down[1]) == len(ky)):
                return kx, kx if own else ky
            kx, ky = down

    def _count(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links between the points i of the first tree and j of the second."""
        np.add.at(self.count_a, i, self.b.weights[j])
        np.add.at(self.count_b if self.a is not self.b else self.count_a, j, self.a.weights[i])
        for x, y in zip(i.tolist(), j.tolist()):
            self.forest.join(x, y + self.shift)

    def _close(self, kx: list[int], ky: list[int], own: bool) -> list[tuple[int, int]]:
        """Pairs of children that the covering radii don't rule out."""
        out = []
        cx = np.array([self.a.nodes[k][0] for k in kx])
        cy = np.array([self.b.nodes[k][0] for k in ky])
        rx = np.array([self.a.nodes[k][1] for k in kx])
        ry = np.array([self.b.nodes[k][1] for k in ky])
        one_x = np.array([len(self.a.nodes[k][2]) == 1 for k in kx])
        one_y = np.array([len(self.b.nodes[k][2]) == 1 for k in ky])
        for low in range(0, len(kx), BLOCK):
            for other in range(low if own else 0, len(ky), BLOCK):
                i, j = slice(low, low + BLOCK), slice(other, other + BLOCK)
                dot = self.a.points[cx[i]] @ self.b.points[cy[j]].T
                most = self.reach + rx[i][:, None] + ry[j][None, :] + MARGIN
                keep = 2 - 2 * dot <= most * most + MARGIN
                if own and low == other:
                    keep = np.triu(keep, 1)
                # Two single points are done here; only other pairs go down.
                both = keep & one_x[i][:, None] & one_y[j][None, :]
                self._count(*(c[k] for c, k in zip((cx[i], cy[j]), np.nonzero(both & (dot >= self.cosine)))))
                for p, q in zip(*(v.tolist() for v in np.nonzero(keep & ~both))):
                    out.append((kx[low + p], ky[other + q]))
        return out


def link_cell(home: np.ndarray, home_w: np.ndarray, guests: np.ndarray, guest_w: np.ndarray, cosine: float = COSINE):
    """(counts of home then guests, spanning edges) of links within ``home``
    and between ``home`` and ``guests``."""
    least = math.sqrt(max(0.0, 2 - 2 * cosine)) / 8
    forest = Forest(len(home) + len(guests))
    tree = CoverTree(home, home_w, least)
    inner = Links(tree, tree, 0, forest, cosine)
    inner.run()
    outer = Links(tree, CoverTree(guests, guest_w, least), len(home), forest, cosine)
    outer.run()
    return np.concatenate([inner.count_a + outer.count_a, outer.count_b]), list(forest.edges())


def unit(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    points = flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
    return points / np.sqrt(np.einsum("ij,ij->i", points, points))[:, None]


def usable(vector: Column) -> Column:
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(v, lambda x: x != 0)


def near_vectors(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("lab"))
    rows = rows.withColumn("ok", F.coalesce(usable(F.col("v")) & F.col("lab").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("lab", "v"), "h2": F.xxhash64(F.lit(1), "v", "lab")})
    points = rows.where("ok").groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v"), F.first("lab").alias("lab")
    )
    points = points.withColumn("lab", F.concat_ws(":", F.size("v"), "lab"))
    points = staged(points, "points")

    sizes = {r[0]: r[1] for r in points.groupBy("lab").count().where(F.col("count") > cell).collect()}
    wanted = {lab: -(-n // cell) for lab, n in sizes.items()}
    centres: dict[str, list] = {}
    if wanted:
        ask = {lab: min(k * SAMPLE_PER_CENTRE, SAMPLE) for lab, k in wanted.items()}
        total, room = sum(sizes.values()), max(SAMPLE, max(ask.values()))
        share = min(1.0, 4.0 * room / total)
        drawn = points.where(F.col("lab").isin(list(wanted))).where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        for r in drawn.orderBy(F.xxhash64("rep"), "rep").limit(room).select("lab", "v").collect():
            centres.setdefault(r[0], []).append(r[1])
    tops = {}
    for lab, k in wanted.items():
        found = np.array(centres.get(lab, [])[: k * SAMPLE_PER_CENTRE], np.float64)
        if len(found):
            tops[lab] = spread(found / np.linalg.norm(found, axis=1)[:, None], k)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labs = np.array(batch.column(2).to_pylist(), object)
            at, away = np.zeros(len(labs), np.int64), np.zeros(len(labs))
            for lab in set(labs.tolist()):
                mine = np.flatnonzero(labs == lab)
                if lab in tops:
                    d = 2 - 2 * unit(batch.take(pa.array(mine)), 1) @ tops[lab].T
                    at[mine] = d.argmin(1)
                    away[mine] = np.sqrt(np.maximum(d.min(1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(away)], ["rep", "v", "lab", "n", "cell", "away"])

    kind = points.schema["v"].dataType.simpleString()
    placed = points.select("rep", "v", "lab", "n").mapInArrow(home, f"rep long, v {kind}, lab string, n long, cell long, away double")
    placed = staged(placed, "cells")
    radii: dict[str, dict[int, float]] = {}
    for r in placed.where(F.col("lab").isin(list(tops))).groupBy("lab", "cell").agg(F.max("away")).collect() if tops else []:
        radii.setdefault(r[0], {})[r[1]] = r[2]
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labs, cells = np.array(batch.column(2).to_pylist(), object), batch.column(4).to_numpy()
            row, to = [np.arange(len(labs))], [cells]
            for lab in set(labs.tolist()) & set(tops):
                mine = np.flatnonzero(labs == lab)
                d = np.sqrt(np.maximum(2 - 2 * unit(batch.take(pa.array(mine)), 1) @ tops[lab].T, 0))
                radius = np.array([radii[lab].get(k, -9.0) for k in range(len(tops[lab]))])
                i, k = np.nonzero((d <= radius[None, :] + reach + 1e-6) & (np.arange(len(radius))[None, :] > cells[mine][:, None]))
                row.append(mine[i])
                to.append(k)
            row, to = np.concatenate(row), np.concatenate(to)
            picked = batch.take(pa.array(row))
            guest = pa.array(np.arange(len(row)) >= len(labs))
            yield pa.RecordBatch.from_arrays(
                [picked.column(2), pa.array(to.astype(np.int64)), picked.column(0), picked.column(3), picked.column(1), guest],
                ["lab", "cell", "rep", "n", "v", "guest"],
            )

    def search(part: pa.Table) -> pa.Table:
        part = part.sort_by("guest").combine_chunks()
        batch = part.to_batches()[0]
        points, weights, reps = unit(batch, 4), batch.column(3).to_numpy().astype(float), batch.column(2).to_numpy()
        own = int((~batch.column(5).to_numpy(zero_copy_only=False).astype(bool)).sum())
        counts, edges = link_cell(points[:own], weights[:own], points[own:], weights[own:], cosine)
        some = np.flatnonzero(counts)
        a = np.concatenate([reps[some], reps[[e[0] for e in edges]] if edges else np.zeros(0, np.int64)])
        b = np.concatenate([np.full(len(some), -1), reps[[e[1] for e in edges]] if edges else np.zeros(0, np.int64)])
        n = np.concatenate([np.round(counts[some]).astype(np.int64), np.zeros(len(edges), np.int64)])
        edge = np.concatenate([np.zeros(len(some), bool), np.ones(len(edges), bool)])
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64)), "n": pa.array(n), "edge": pa.array(edge)})

    shown = placed.mapInArrow(visit, f"lab string, cell long, rep long, n long, v {kind}, guest boolean")
    found = staged(shown.groupBy("lab", "cell").applyInArrow(search, "a long, b long, n long, edge boolean"), "vector-links")
    joined = components(found.where("edge").select("a", "b"))
    counts = found.where("not edge").groupBy("a").agg(F.sum("n").alias("others"))
    classes = (
        points.select("h1", "h2", "rep", "n")
        .join(joined, F.col("rep") == F.col("node"), "left").join(counts, F.col("rep") == F.col("a"), "left")
        .select(
            F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("component", "rep").alias("component"),
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"),
        )
    )
    on = (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("ok")
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("id"))
    return rows.select("id", "ok", "h1", "h2").join(classes, on, "left").select(
        F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("id") == component).alias("kept"),
    )


def spread(points: np.ndarray, k: int) -> np.ndarray:
    """k centres, each the point farthest from those before it or, every other
    time, a point at random, so that dense regions are divided too."""
    rng = np.random.default_rng(SEED)
    chosen = [0]
    away = 2 - 2 * points @ points[0]
    while len(chosen) < min(k, len(points)):
        nxt = int(away.argmax()) if len(chosen) % 2 else int(rng.integers(len(points)))
        chosen.append(nxt)
        away = np.minimum(away, 2 - 2 * points @ points[nxt])
    return np.unique(points[chosen], axis=0)


def op6_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs within labels, and the closure of their links.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL
  AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS s FROM v WHERE list_inner_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.s * b.s) >= {COSINE}),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON x = vec_id
"""
