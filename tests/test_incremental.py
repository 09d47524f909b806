"""Incremental components and tiered resolution against full runs and loops."""

import random
import re

from pyspark.sql import functions as F

from siftwright.operators import graph, incremental, resolution
from tests.conftest import SMALL


def brute_labels(nodes, edges):
    near = {n: set() for n in nodes}
    for a, b in edges:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for n in sorted(nodes):
        todo = [n] if n not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def test_labels_after_random_changes_equal_a_full_run(spark):
    rng = random.Random(4)
    nodes = set(range(60))
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(30)}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "src long, dst long")
    points = lambda rows: spark.createDataFrame([(n,) for n in sorted(rows)], "node long")
    labels = graph.components(frame(edges), points(nodes)).select("node", "component")
    for step in range(4):
        gone = {n for n in nodes if rng.random() < 0.1} if step % 2 else set()
        new = set(range(100 + 10 * step, 104 + 10 * step))
        cut = {e for e in edges if rng.random() < 0.2 or gone & set(e)}
        nodes2 = (nodes - gone) | new
        add = {(rng.choice(sorted(nodes2)), rng.choice(sorted(nodes2))) for _ in range(5)}
        edges2 = (edges - cut) | add
        labels = incremental.relabelled(points(nodes2), frame(edges2), labels, frame(cut), frame(add))
        assert {r["node"]: r["component"] for r in labels.collect()} == brute_labels(nodes2, edges2)
        nodes, edges = nodes2, edges2


def test_untouched_components_are_not_computed_again(spark):
    """Labels outside the region are taken as they are, right or not."""
    old = spark.createDataFrame([(1, 1), (2, 1), (8, 77), (9, 77)], "node long, component long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "src long, dst long")
    got = incremental.relabelled(spark.createDataFrame([(1,), (2,), (3,), (8,), (9,)], "node long"), edges, old, edges.limit(0), edges.where("dst = 3"))
    assert {r["node"]: r["component"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 8: 77, 9: 77}


def resolve_one(edge, symbols):
    _, repo, file, a, b, kind = edge
    mine = [s for s in symbols if s[1] == repo]
    classes = resolution.CLASS_KINDS
    rank = {"class": 0, "function": 1}

    def tiers(name, source):
        if name is None:
            return None
        local = [s[0] for s in mine if s[2] == file and s[3] == name]
        if source and kind in resolution.CLASS_SOURCES:
            yes = [s[0] for s in mine if s[2] == file and s[3] == name and s[4] in classes]
            wide = [s[0] for s in mine if s[3] == name and s[4] in classes]
            if yes or wide:
                return max(yes) if yes else min(wide)
        if local:
            return max(local)
        if source and re.search(r"[/\\]", name):
            of = sorted((s[5], s[0]) for s in mine if s[2] == name)
            if of:
                return of[0][1]
        every = sorted((rank.get(s[4], 2), s[0]) for s in mine if s[3] == name)
        return every[0][1] if every else None

    src, dst = tiers(a, True), tiers(b, False)
    return src, dst if dst is not None else b if kind in resolution.INHERITANCE and b is not None else None


def test_resolution_equals_the_loop(spark):
    rng = random.Random(2)
    names = ["A", "B", "C", "x/y.py", "D"]
    symbols = [(i, rng.choice("pq"), rng.choice(["x/y.py", "z.py"]), rng.choice(names[:4]), rng.choice(["class", "function", "struct", "method"]), rng.randrange(9)) for i in range(1, 25)]
    edges = [(i, rng.choice("pq"), rng.choice(["x/y.py", "z.py", "new.py"]), rng.choice([*names, None]), rng.choice([*names, "Out", None]), rng.choice(["calls", "extends", "tested_by", "implements"])) for i in range(300)]
    found = resolution.resolve_edges(
        spark.createDataFrame(edges, "edge_id long, repo string, file string, from_symbol string, to_symbol string, edge_type string"),
        spark.createDataFrame(symbols, "node long, repo string, path string, name string, kind string, line_start long"),
    )
    stubs = {r["node"]: r["name"] for r in found.stubs.collect()}
    got = {r["edge_id"]: (r["src"], stubs.get(r["dst"], r["dst"])) for r in found.edges.collect()}
    want = {e[0]: resolve_one(e, symbols) for e in edges}
    assert got == {k: v for k, v in want.items() if None not in v}
    assert {r["edge_id"]: r["reason"] for r in found.dropped.collect()} == {k: "neither" if v == (None, None) else "source" if v[0] is None else "target" for k, v in want.items() if None in v}
    assert len(stubs) == len({(r["repo"], r["name"]) for r in found.stubs.collect()}) and all(n < 0 for n in stubs)


def test_a_name_with_many_candidates_is_not_paired_with_its_edges(spark):
    symbols = spark.range(100_000).select(F.col("id").alias("node"), F.lit("r").alias("repo"), F.concat(F.lit("f"), F.col("id")).alias("path"), F.lit("get").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("line_start"))
    edges = spark.range(100_000).select(F.col("id").alias("edge_id"), F.lit("r").alias("repo"), F.concat(F.lit("f"), F.col("id") % 100).alias("file"), F.lit("get").alias("from_symbol"), F.lit("get").alias("to_symbol"), F.lit("calls").alias("edge_type"))
    found = resolution.resolve_edges(edges, symbols).edges
    assert found.count() == 100_000 and found.where("src <> cast(substring(concat('f', edge_id % 100), 2) AS long)").count() == 0


def test_best_targets_by_name_without_pairs(spark):
    """5,000 candidates and 5,000 edges of one name: neither the plan nor a task
    holds their 25 million pairs, and rows of one id share the best target."""
    names = spark.range(5000).selectExpr("id AS node", "'n' AS name", "CAST(CASE WHEN id < 10 THEN NULL ELSE id % 50 END AS INT) AS pr")
    names = names.union(spark.sql("SELECT * FROM VALUES (7L, 'm', 90), (6L, 'm', 90), (1L, CAST(NULL AS STRING), 0), (9L, 'only', CAST(NULL AS INT)) v(node, name, pr)"))
    edges = spark.range(5000).selectExpr("id AS edge_id", "'n' AS target_name")
    edges = edges.union(spark.sql("SELECT * FROM VALUES (-1L, 'm'), (-2L, 'none'), (-3L, CAST(NULL AS STRING)), (-4L, 'only'), (0L, 'm'), (-1L, 'n'), (-5L, 'x'), (-5L, 'a') v(edge_id, target_name)"))
    found = graph.resolve(edges, names, F.col("pr"))
    got = {r["edge_id"]: (r["node"], r["external"], r["target_name"]) for r in found.collect()}
    assert {got[k] for k in range(5000)} == {(50, False, "n")} and len(got) == 5005
    assert {k: got[-k] for k in range(1, 6)} == {1: (50, False, "n"), 2: (None, True, "none"), 3: (None, True, None), 4: (9, False, "only"), 5: (None, True, "a")}
    nodes, most = [found._jdf.queryExecution().executedPlan().finalPhysicalPlan()], 0
    while nodes:
        node = nodes.pop()
        while node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert 5000 <= most < 20_000


def test_stubs_where_a_name_has_many_candidates(spark):
    """40,000 edges of one name with 40,000 candidates and 40,000 of one without:
    1.6 billion pairs, were they made."""
    names = spark.range(40_000).selectExpr("id AS node", "'n' AS name", "1 AS pr")
    edges = spark.range(80_000).selectExpr("id AS edge_id", "CASE WHEN id % 2 = 0 THEN 'n' ELSE 'gone' END AS target_name")
    linked, stubs = graph.with_stubs(graph.resolve(edges, names, F.col("pr")).select("edge_id", "node", "external", "target_name"))
    (stub,) = stubs.collect()
    assert stub["name"] == "gone" and stub["kind"] == "external" and stub["node"] < 0
    assert {(r["node"], r["count"]) for r in linked.groupBy("node").count().collect()} == {(0, 40_000), (stub["node"], 40_000)}


def test_large_staged_tables_are_not_broadcast(spark):
    """Compressed files of a staged table are far smaller than its rows."""
    symbols = spark.range(2000).selectExpr("id AS node", "concat('w', id) AS name", "'function' AS kind", "concat('src/', id % 50, '.py') AS path", "CAST(NULL AS INT) AS community")
    edges = spark.range(1900).selectExpr("id AS src", "id + 100 AS dst", "'calls' AS edge_type")
    plans = [graph.finalised(symbols, edges)[0], incremental.finish(symbols, edges).labels, graph.components(edges, symbols.select("node"))]
    done = incremental.finish(symbols, edges)
    plans.append(done.labels.join(done.edges, done.labels["node"] == done.edges["src"]))
    assert all(p.count() >= 1900 for p in plans)
    assert not any("BroadcastHashJoin" in p._jdf.queryExecution().executedPlan().toString() for p in plans[2:])


def staged_plans(monkeypatch, module):
    """Plans of what a module stages from now on."""
    plans, whole = [], graph.staged

    def record(df, large=False):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, large)

    monkeypatch.setattr(module, "staged", record)
    return plans


def test_an_index_of_parts_is_made_without_broadcasts(spark, monkeypatch):
    from siftwright.plans import boosts

    plans = staged_plans(monkeypatch, boosts)
    boosts.reindexed_components(spark, SMALL)
    assert len(plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_paths_of_flows_meet_edges_without_broadcasts(spark, monkeypatch):
    edges = spark.range(3000).selectExpr("id AS src", "id + 1000 AS dst")
    plans = staged_plans(monkeypatch, graph)
    found = graph.flows(edges, spark.range(1000).toDF("node"), max_depth=4)
    assert found.where("leaf = entry + 3000 AND size(path) = 4").count() == 1000
    assert len(plans) >= 4 and not any("Broadcast" in p for p in plans)
