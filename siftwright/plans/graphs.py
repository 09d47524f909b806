"""Graph analytics over customer-supplier edges and a sparse part graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.operators import graph, memory, wiki, workspace
from siftwright.plans.registry import query, table, values, values_sql

TYPE = "CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'calls' WHEN 'NF' THEN 'imports' WHEN 'NO' THEN 'extends' WHEN 'RF' THEN 'tested_by' ELSE 'implements' END"
#: Customers call suppliers; supplier ids are lifted above customer ids.
EDGES = f"WITH edges AS (SELECT o_custkey AS src, 1000000 + l_suppkey AS dst, {TYPE} AS edge_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey), nodes AS (SELECT c_custkey AS node, c_nationkey AS community, c_mktsegment AS file, c_name AS name FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_nationkey, 'sup' || (s_suppkey % 7), s_name FROM supplier) "
#: A sparse graph over all parts: small ones point to the next part, those of
#: one brand to the seventh.
SPARSE = "WITH sp AS (SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_size < 20 UNION ALL SELECT p_partkey, p_partkey + 7 FROM part WHERE p_brand = 'Brand#11'), "


def edges(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.selectExpr("o_custkey AS src", "1000000 + l_suppkey AS dst", f"{TYPE} AS edge_type")


def nodes(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS node", "c_nationkey AS community", "c_mktsegment AS file", "c_name AS name")
    s = table(spark, d, "supplier").selectExpr("1000000 + s_suppkey AS node", "s_nationkey AS community", "concat('sup', s_suppkey % 7) AS file", "s_name AS name")
    return c.unionByName(s)


def entries(spark, d):
    """Nodes that point somewhere and that nothing points to."""
    e = sparse(spark, d)
    return e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def sparse(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_size < 20").selectExpr("p_partkey AS src", "p_partkey + 1 AS dst")
    b = p.where("p_brand = 'Brand#11'").selectExpr("p_partkey AS src", "p_partkey + 7 AS dst")
    return a.unionByName(b)


@query(EDGES + ", c AS (SELECT dst AS node, count(*) AS inbound FROM edges WHERE edge_type IN ('calls', 'imports', 'extends', 'implements') GROUP BY dst) SELECT node, inbound, round(inbound / (SELECT max(inbound) FROM c), 6) AS hub FROM c")
def hub_scores(spark, d):
    return graph.hub_scores(edges(spark, d)).select("node", "inbound", F.round("hub", 6).alias("hub"))


@query(
    EDGES + ", c AS (SELECT src AS node, count(DISTINCT community) AS reached FROM edges JOIN nodes ON dst = node WHERE edge_type IN ('calls', 'imports') AND community IS NOT NULL GROUP BY src HAVING count(DISTINCT community) > 1) "
    "SELECT node, reached, round(reached / (SELECT max(reached) FROM c), 6) AS bridge FROM c"
)
def bridge_scores(spark, d):
    return graph.bridge_scores(edges(spark, d), nodes(spark, d).select("node", "community")).select("node", "reached", F.round("bridge", 6).alias("bridge"))


@query(
    EDGES + ", u AS (SELECT dst AS node, count(*) AS inbound FROM edges WHERE edge_type IN ('calls', 'imports') GROUP BY dst), h AS (SELECT u.node, inbound, name, row_number() OVER (ORDER BY inbound DESC, name, u.node) AS k FROM u JOIN nodes ON u.node = nodes.node "
    "WHERE u.node NOT IN (SELECT src FROM edges WHERE edge_type = 'tested_by' AND src IS NOT NULL)) "
    "SELECT node, inbound, name FROM h WHERE k <= greatest(1, least(round_even((SELECT count(*) FROM u) * 0.10, 0), 50))"
)
def untested_hotspots(spark, d):
    return graph.untested_hotspots(edges(spark, d), nodes(spark, d).select("node", "name")).select("node", "inbound", "name")


@query(
    EDGES + "SELECT DISTINCT b.file FROM edges JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node WHERE a.file = 'BUILDING' AND b.file <> 'BUILDING' "
    "UNION SELECT DISTINCT a.file FROM edges JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node WHERE b.file = 'BUILDING' AND a.file <> 'BUILDING'"
)
def adjacent_files(spark, d):
    return graph.adjacent(edges(spark, d), nodes(spark, d).select("node", "file"), "file", F.lit("BUILDING"))


@query(
    "WITH RECURSIVE " + SPARSE[5:] + "b AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_size = 1 UNION SELECT sp.dst, b.depth + 1 FROM b JOIN sp ON sp.src = b.node WHERE b.depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY node"
)
def call_chain_nodes(spark, d):
    seeds = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("node"))
    return graph.bfs(sparse(spark, d), seeds, 3)


@query(
    "WITH RECURSIVE " + SPARSE[5:] + "b AS (SELECT p_partkey AS node, 0 AS depth FROM part WHERE p_brand = 'Brand#11' UNION SELECT sp.dst, b.depth + 1 FROM b JOIN sp ON sp.src = b.node WHERE b.depth < 3), "
    "m AS (SELECT node, min(depth) AS depth FROM b GROUP BY node) SELECT p_brand AS file, min(depth) AS depth FROM m JOIN part ON node = p_partkey WHERE p_brand <> 'Brand#11' GROUP BY p_brand"
)
def call_chain_groups(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("file"))
    reached = graph.bfs(sparse(spark, d), p.where("file = 'Brand#11'").select("node"), 3)
    return reached.join(p, "node").where("file <> 'Brand#11'").groupBy("file").agg(F.min("depth").alias("depth"))


@query(
    "WITH RECURSIVE " + SPARSE[5:] + "e AS (SELECT src AS a, dst AS b FROM sp UNION SELECT dst, src FROM sp), n AS (SELECT a AS node FROM e UNION SELECT p_partkey FROM part), "
    "r AS (SELECT node, node AS reach FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node) "
    "SELECT node, component, CAST(dense_rank() OVER (ORDER BY component) - 1 AS INTEGER) AS community FROM c"
)
def components(spark, d):
    e = sparse(spark, d)
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).union(table(spark, d, "part").select("p_partkey"))
    return graph.components(e, n)


@query(
    "WITH RECURSIVE " + SPARSE[5:] + "s AS (SELECT DISTINCT src, dst FROM sp), f AS (SELECT src AS entry, src AS at, [src] AS path FROM s WHERE src NOT IN (SELECT dst FROM s) GROUP BY src "
    "UNION ALL SELECT f.entry, s.dst, list_append(f.path, s.dst) FROM f JOIN s ON s.src = f.at WHERE NOT list_contains(f.path, s.dst)), "
    "x AS (SELECT f.entry, f.at AS leaf, f.path FROM f WHERE len(f.path) > 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.src = f.at AND NOT list_contains(f.path, s.dst))) "
    "SELECT entry, leaf, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY entry, leaf ORDER BY len(path), path) AS k FROM x) y WHERE k = 1"
)
def flows(spark, d):
    out = graph.flows(sparse(spark, d), entries(spark, d))
    return out.select("entry", "leaf", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


USED = (
    EDGES + ", dg AS (SELECT dst AS node, count(*) AS inbound FROM edges WHERE edge_type IN ('calls', 'imports', 'extends', 'implements') GROUP BY dst), "
    "f AS (SELECT nodes.node, community, file, name, coalesce(inbound, 0) AS inbound FROM nodes LEFT JOIN dg ON nodes.node = dg.node), "
    "c AS (SELECT *, row_number() OVER (ORDER BY inbound DESC, symbols DESC, community) AS rank FROM (SELECT community, CAST(sum(inbound) AS BIGINT) AS inbound, count(*) AS symbols FROM f GROUP BY community) x), "
    "fs AS (SELECT community, file, sum(inbound) AS s, row_number() OVER (PARTITION BY community ORDER BY sum(inbound) DESC, file) AS k FROM f GROUP BY community, file), "
    "hs AS (SELECT community, name, inbound, row_number() OVER (PARTITION BY community ORDER BY inbound DESC, name, node) AS k FROM f WHERE inbound > 0) "
)


@query(
    USED + "SELECT community, inbound, symbols, CAST(rank AS INTEGER) AS rank, (SELECT string_agg(file, ',' ORDER BY k) FROM fs WHERE fs.community = c.community AND k <= 5) AS top_files, "
    "(SELECT string_agg(name, ',' ORDER BY k) FROM hs WHERE hs.community = c.community AND k <= 5) AS top_hubs FROM c WHERE rank <= 8"
)
def subsystems(spark, d):
    return graph.subsystems(nodes(spark, d), edges(spark, d))


@query(
    USED + ", se AS (SELECT rank, community, symbols, inbound, (SELECT string_agg(file, ', ' ORDER BY k) FROM fs WHERE fs.community = c.community AND k <= 8) AS files, (SELECT count(*) FROM fs WHERE fs.community = c.community AND k <= 8) AS n_files, "
    "(SELECT string_agg(name || ' (inbound=' || inbound || ')', ', ' ORDER BY k) FROM hs WHERE hs.community = c.community AND k <= 3) AS hubs, (SELECT string_agg(name, ', ' ORDER BY k) FROM hs WHERE hs.community = c.community AND k <= 3) AS names, "
    "(SELECT name FROM hs WHERE hs.community = c.community AND k = 1) AS title FROM c WHERE rank <= 8), "
    r"t AS (SELECT *, 'subsystem-' || regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') || '-' || community AS anchor FROM se) "
    "SELECT '# demo — subsystem wiki' || chr(10) || chr(10) || 'Generated on 2024-01-31.' || chr(10) || chr(10) || '## TOC' || chr(10) || string_agg('- [Subsystem: ' || title || '](#' || anchor || ')', chr(10) ORDER BY rank) || chr(10) || chr(10) || "
    "string_agg('## Subsystem: ' || title || chr(10) || chr(10) || '**Key files**: ' || files || chr(10) || chr(10) || '**Hub symbols**: ' || hubs || chr(10) || chr(10) || 'This subsystem contains ' || n_files || ' file(s) and ' || symbols || ' symbol(s). "
    "The most connected symbols are ' || names || '. Total inbound references across hub edges: ' || inbound || '.' || chr(10), chr(10) ORDER BY rank) AS text FROM t"
)
def wiki_page(spark, d):
    return wiki.page(wiki.sections(nodes(spark, d), edges(spark, d)), "demo", "2024-01-31")


@query(EDGES + "SELECT count(*) AS cross_edges FROM edges JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node WHERE a.community <> b.community")
def coupling(spark, d):
    return graph.coupling(edges(spark, d), nodes(spark, d).select("node", "community"))


@query(
    SPARSE[:-2] + ", g AS (SELECT src AS node FROM sp UNION ALL SELECT dst FROM sp), t AS (SELECT node FROM g GROUP BY node ORDER BY count(*) DESC, node LIMIT 300) SELECT src, dst FROM sp WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)"
)
def top_degree_subgraph(spark, d):
    return graph.top_degree_subgraph(sparse(spark, d), 300).select("src", "dst")


@query(
    SPARSE + "p AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#12'), n AS (SELECT src AS of, dst AS node FROM sp WHERE src IN (SELECT node FROM p) UNION ALL SELECT dst, src FROM sp WHERE dst IN (SELECT node FROM p)) "
    "SELECT node, count(DISTINCT of) AS referrers FROM n WHERE node NOT IN (SELECT node FROM p) GROUP BY node ORDER BY count(DISTINCT of) DESC, node LIMIT 3"
)
def next_suggestions(spark, d):
    p = table(spark, d, "part").where("p_brand = 'Brand#12'").select(F.col("p_partkey").alias("node"))
    return graph.next_suggestions(sparse(spark, d), p)


SYMBOLS = [
    (1, "foo_bar", "function", "src/a.py"), (2, "FooBar", "class", "src/b.py"), (3, "test_foo_bar", "function", "tests/test_a.py"), (4, "foo_bar", "function", "lib/c.py"),
    (5, "test_missing", "function", "test_b.py"), (6, "test_foo_bar", "class", "test_c.py"), (7, "test_x", "function", "src/x.py"), (8, "helper", "function", "tests/test_a.py"), (9, "x", "function", "x.py"),
]
LINKS = [(4, 3), (2, 3)]


@query(
    f"SELECT a AS src, b AS dst FROM {values_sql(LINKS)} UNION ALL SELECT 1000 + s_suppkey, 100000 + c_custkey FROM (SELECT max(c_custkey) AS c_custkey, c_custkey % 300 AS k FROM customer GROUP BY 2) c JOIN supplier ON s_suppkey = k"
)
def test_links(spark, d):
    cases = values(spark, SYMBOLS).toDF("node", "name", "kind", "path")
    s = table(spark, d, "supplier").selectExpr("1000 + s_suppkey AS node", "concat('s', s_suppkey) AS name", "'function' AS kind", "'src/s.py' AS path")
    t = table(spark, d, "customer").selectExpr("100000 + c_custkey AS node", "concat('test_s', c_custkey % 300) AS name", "'function' AS kind", "'tests/test_s.py' AS path")
    return workspace.test_links(cases.unionByName(s).unionByName(t))


test_links.__test__ = False


@query(
    "WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, 'n' || (l_partkey % 400) AS target FROM lineitem), n AS (SELECT p_partkey AS node, 'n' || (p_partkey % 350) AS name, p_size AS pr FROM part), "
    "j AS (SELECT edge_id, node, row_number() OVER (PARTITION BY edge_id ORDER BY pr NULLS LAST, node NULLS LAST) AS k FROM e LEFT JOIN n ON target = name) SELECT edge_id, node, node IS NULL AS external FROM j WHERE k = 1"
)
def edge_resolve(spark, d):
    e = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS edge_id", "concat('n', l_partkey % 400) AS target_name")
    n = table(spark, d, "part").selectExpr("p_partkey AS node", "concat('n', p_partkey % 350) AS name", "p_size AS pr")
    return graph.resolve(e, n, F.col("pr")).select("edge_id", "node", "external")


@query("SELECT edge_type, count(*) AS n FROM (" + f"SELECT {TYPE} AS edge_type FROM lineitem" + ") x GROUP BY edge_type")
def edge_type_counts(spark, d):
    return table(spark, d, "lineitem").selectExpr(f"{TYPE} AS edge_type").groupBy("edge_type").agg(F.count("*").alias("n"))


@query("SELECT sha1(count(*) || ':' || coalesce(max(o_orderkey), 0) || '|' || 'orders' || '|') AS fingerprint FROM orders")
def index_fingerprint(spark, d):
    g = table(spark, d, "orders").agg(F.count("*").alias("n"), F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("m"))
    return g.select(memory.cache_key(F.concat_ws(":", F.col("n").cast("string"), F.col("m").cast("string")), F.lit("orders")).alias("fingerprint"))


@query(
    "WITH s AS (SELECT p_partkey, p_brand AS path, p_size AS a, p_size + 5 AS b FROM part), c AS (SELECT DISTINCT p_brand AS path, p_size * 2 AS line FROM part WHERE p_size > 10) SELECT DISTINCT p_partkey FROM s JOIN c ON s.path = c.path AND c.line BETWEEN a AND b"
)
def diff_overlap(spark, d):
    s = table(spark, d, "part").selectExpr("p_partkey", "p_brand AS path", "p_size AS a", "p_size + 5 AS b")
    c = table(spark, d, "part").where("p_size > 10").selectExpr("p_brand AS path", "p_size * 2 AS line").distinct()
    return workspace.diff_overlap(s, c, "path", "a", "b").select("p_partkey")
