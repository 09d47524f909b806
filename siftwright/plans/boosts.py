"""Boosts, caps and pins over candidates and graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.operators import boosts, graph, incremental, resolution
from siftwright.operators.graph import staged
from siftwright.plans.graphs import EDGES, edges, nodes
from siftwright.plans.ranking import ITEMS, items
from siftwright.plans.registry import query, table, values, values_sql

GRAPH_ITEMS = EDGES + ", items AS (SELECT node, round((node * 37 % 100) / 100.0, 2) AS confidence FROM nodes) "


def graph_items(spark, d):
    return nodes(spark, d).select("node", F.expr("round((node * 37 % 100) / 100.0, 2)").cast("double").alias("confidence"))


@query(
    GRAPH_ITEMS + ", c AS (SELECT dst AS node, count(*) AS n FROM edges WHERE edge_type IN ('calls', 'imports', 'extends', 'implements') GROUP BY dst), "
    "b AS (SELECT src AS node, count(DISTINCT community) AS n FROM edges JOIN nodes ON dst = node WHERE edge_type IN ('calls', 'imports') GROUP BY src HAVING count(DISTINCT community) > 1), "
    "g AS (SELECT items.node, confidence, least(0.10, 0.07 * coalesce(c.n / (SELECT max(n) FROM c), 0) + 0.05 * coalesce(b.n / (SELECT max(n) FROM b), 0)) AS gain FROM items LEFT JOIN c ON c.node = items.node LEFT JOIN b ON b.node = items.node) "
    "SELECT node, round(CASE WHEN gain > 0 THEN least(0.95, confidence + gain) ELSE confidence END, 6) AS confidence FROM g"
)
def hub_bridge_boost(spark, d):
    e = edges(spark, d)
    out = boosts.hub_bridge(graph_items(spark, d), graph.hub_scores(e), graph.bridge_scores(e, nodes(spark, d).select("node", "community")))
    return out.select("node", F.round("confidence", 6).alias("confidence"))


@query(
    "WITH s AS (SELECT p_partkey AS id, p_brand AS path, p_size * 10 AS a, p_size * 10 + p_partkey % 90 - 5 AS b, round((p_partkey % 100) / 100.0, 2) AS c FROM part), "
    "l AS (SELECT DISTINCT p_brand AS path, p_partkey % 600 AS line FROM part WHERE p_partkey % 7 = 0), h AS (SELECT DISTINCT id FROM s JOIN l ON s.path = l.path AND line BETWEEN a AND b WHERE a <= b) "
    "SELECT s.id, h.id IS NOT NULL AS hit, round(CASE WHEN h.id IS NOT NULL THEN least(0.95, c + 0.15) ELSE c END, 6) AS confidence FROM s LEFT JOIN h ON s.id = h.id"
)
def diff_boost(spark, d):
    p = table(spark, d, "part")
    s = p.selectExpr("p_partkey AS id", "p_brand AS path", "p_size * 10 AS a", "p_size * 10 + p_partkey % 90 - 5 AS b", "CAST(round((p_partkey % 100) / 100.0, 2) AS DOUBLE) AS confidence")
    lines = p.where("p_partkey % 7 = 0").selectExpr("p_brand AS path", "p_partkey % 600 AS line")
    return boosts.diff_aware(s, lines, "id", "path", "a", "b").select("id", "hit", F.round("confidence", 6).alias("confidence"))


@query(
    "SELECT page_id, round(CASE WHEN regexp_matches(substr(html, 1, 262144), '[\"''`]/(the|eaux)[\"''`?/)\\s]') THEN least(0.95, (page_id % 100) / 100.0 + 0.10) ELSE (page_id % 100) / 100.0 END, 6) AS confidence FROM pages"
)
def contract_boost(spark, d):
    p = table(spark, d, "pages")
    found = p.selectExpr("page_id", "CAST(page_id AS STRING) AS path", "CAST((page_id % 100) / 100.0 AS DOUBLE) AS confidence")
    files = p.selectExpr("CAST(page_id AS STRING) AS path", "html AS text")
    return boosts.contract_consumers(found, files, ["/the", "/eaux"]).select("page_id", F.round("confidence", 6).alias("confidence"))


@query(
    ITEMS + "SELECT ord, round(CASE WHEN ord % 3 = 0 THEN greatest(0, least(0.95, confidence + 0.4)) WHEN ord % 3 = 1 THEN greatest(0, least(0.95, confidence - 0.3)) ELSE confidence END, 6) AS confidence FROM items"
)
def feedback_apply(spark, d):
    i = items(spark, d).withColumn("path", F.concat("path", F.lit("#"), (F.col("ord") % 3).cast("string")))
    deltas = i.where("ord % 3 < 2").select("path", F.when(F.col("ord") % 3 == 0, 0.4).otherwise(-0.3).alias("delta")).distinct()
    return boosts.feedback(i, deltas).select("ord", F.round("confidence", 6).alias("confidence"))


CHAIN = "SELECT p_partkey AS src, p_partkey + 1 AS dst FROM {p} WHERE p_size < 30"
OWNERS = "SELECT p_partkey AS node, 'f' || CAST(floor(p_partkey / 2) AS BIGINT) AS file FROM {p}"


@query(
    "WITH c AS (" + CHAIN.format(p="part") + "), n AS (" + OWNERS.format(p="part") + "), ch AS (SELECT DISTINCT file FROM n WHERE node % 40 = 0), nr AS (SELECT DISTINCT file FROM n WHERE node % 80 = 2), "
    "a AS (SELECT dst AS node FROM c WHERE src IN (SELECT node FROM n JOIN ch USING (file))), b AS (SELECT dst AS node FROM c WHERE src IN (SELECT node FROM a)) "
    "SELECT DISTINCT file, 0.35::DOUBLE AS confidence FROM n WHERE node IN (SELECT node FROM a UNION SELECT node FROM b) AND file NOT IN (SELECT file FROM ch) AND file NOT IN (SELECT file FROM nr)"
)
def transitive_blast(spark, d):
    p = table(spark, d, "part")
    n = spark.sql(OWNERS, p=p)
    return boosts.transitive_blast(spark.sql(CHAIN, p=p), n, n.where("node % 40 = 0").select("file"), n.where("node % 80 = 2").select("file"))


CODE = "SELECT p_partkey AS node, CASE WHEN p_partkey % 9 = 0 THEN 'tests/test_m' || (p_partkey % 40) || '.py' ELSE 'src/m' || (p_partkey % 40) || '.py' END AS path, p_name AS name FROM {p}"


@query(
    "WITH s AS (" + CODE.format(p="part") + "), e AS (" + CHAIN.format(p="part") + "), c AS (SELECT DISTINCT path FROM s WHERE path IN ('src/m3.py', 'src/m17.py')), "
    "x AS (SELECT a.path AS p1, b.path AS p2 FROM e JOIN s a ON e.src = a.node JOIN s b ON e.dst = b.node WHERE a.path <> b.path), n AS (SELECT p2 AS path FROM x WHERE p1 IN (SELECT path FROM c) UNION SELECT p1 FROM x WHERE p2 IN (SELECT path FROM c)) "
    "SELECT node, CASE WHEN path IN (SELECT path FROM c) THEN 'changed_file' WHEN path IN (SELECT path FROM n) THEN 'blast_radius' WHEN path IN ('tests/test_m3.py', 'tests/test_m17.py') THEN 'impacted_test' WHEN path = 'src/m9.py' THEN 'config' WHEN contains(name, 'green') THEN 'query_match' ELSE 'file' END AS category FROM s"
)
def review_candidates(spark, d):
    from siftwright.functions import text as tx

    p = table(spark, d, "part")
    s = spark.sql(CODE, p=p)
    changed = s.where("path IN ('src/m3.py', 'src/m17.py')").select("path").distinct()
    out = boosts.review_candidates(s, spark.sql(CHAIN, p=p), changed, tx.is_test_file(F.col("path")), F.col("path") == "src/m9.py", F.contains("name", F.lit("green")))
    return out.select("node", "category")


@query(
    ITEMS + ", m AS (SELECT *, coalesce(max(CASE WHEN path NOT LIKE 'tests/%' THEN confidence END) OVER (PARTITION BY repo), 0) AS best FROM items) "
    "SELECT ord, round(CASE WHEN path LIKE 'tests/%' AND best >= 0.7 * confidence THEN confidence * 0.85 ELSE confidence END, 6) AS confidence, round(CASE WHEN path LIKE 'tests/%' AND best >= 0.7 * confidence THEN confidence * 0.65 ELSE confidence END, 6) AS discovery FROM m"
)
def test_penalty(spark, d):
    i = items(spark, d).withColumn("discovery", F.col("confidence"))
    out = boosts.test_penalty(i, ["repo"], "confidence", F.col("path"))
    return boosts.test_penalty(out, ["repo"], "discovery", F.col("path"), discovery=True).select("ord", F.round("confidence", 6).alias("confidence"), F.round("discovery", 6).alias("discovery"))


test_penalty.__test__ = False


@query(
    ITEMS + ", r AS (SELECT repo, ord, est_tokens, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, ord) AS k FROM items) "
    "SELECT '3' AS k, repo, ord, CAST(sum(est_tokens) OVER (PARTITION BY repo) AS BIGINT) AS total_tokens FROM r WHERE k <= 3 UNION ALL SELECT '-1', repo, ord, CAST(sum(est_tokens) OVER (PARTITION BY repo) AS BIGINT) FROM r"
)
def top_k_cap(spark, d):
    i = items(spark, d)
    part = lambda k: boosts.top_k(i, ["repo"], k).select(F.lit(str(k)).alias("k"), "repo", "ord", "total_tokens")
    return part(3).union(part(-1))


@query(
    ITEMS + ", page AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, ord) AS k FROM items WHERE kind <> 'file'), p5 AS (SELECT * FROM page WHERE k <= 5), "
    "pin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, ord) AS q FROM items WHERE kind = 'file') x WHERE q = 1), "
    "u AS (SELECT repo, ord, 0 AS k FROM pin UNION ALL SELECT repo, ord, k FROM p5 WHERE NOT EXISTS (SELECT 1 FROM pin WHERE pin.repo = p5.repo AND pin.path = p5.path AND pin.title = p5.title)) "
    "SELECT repo, ord, slot FROM (SELECT repo, ord, row_number() OVER (PARTITION BY repo ORDER BY k) - 1 AS slot FROM u) z WHERE slot < 5"
)
def minimal_pinned(spark, d):
    i = items(spark, d)
    return boosts.pinned_pack(i.where("kind <> 'file'"), i, ["repo"])


@query(
    "WITH RECURSIVE " + ITEMS[5:] + ", pin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, ord) AS q FROM items WHERE kind NOT IN ('memory', 'decision', 'runtime_signal', 'failing_test') AND path NOT LIKE 'tests/%') x WHERE q = 1), "
    "sel AS (SELECT * FROM items WHERE confidence < 0.5), has AS (SELECT DISTINCT sel.repo FROM sel JOIN pin ON sel.repo = pin.repo AND sel.path = pin.path), "
    "u AS (SELECT repo, ord, est_tokens, confidence, true AS pin FROM pin WHERE repo NOT IN (SELECT repo FROM has) UNION ALL SELECT repo, ord, est_tokens, confidence, false FROM sel), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY pin DESC, confidence DESC, ord) AS i FROM u), "
    "f AS (SELECT repo, i, ord, pin OR est_tokens <= 2000 AS take, CASE WHEN pin OR est_tokens <= 2000 THEN est_tokens ELSE 0 END AS used FROM r WHERE i = 1 "
    "UNION ALL SELECT r.repo, r.i, r.ord, r.pin OR f.used + r.est_tokens <= 2000, CASE WHEN r.pin OR f.used + r.est_tokens <= 2000 THEN f.used + r.est_tokens ELSE f.used END FROM f JOIN r ON r.repo = f.repo AND r.i = f.i + 1) "
    "SELECT repo, ord FROM f WHERE take AND repo NOT IN (SELECT repo FROM has) UNION ALL SELECT repo, ord FROM sel WHERE repo IN (SELECT repo FROM has)"
)
def source_pinned(spark, d):
    i = items(spark, d)
    return boosts.pinned_source(i, i.where("confidence < 0.5"), ["repo"], 2000)


VOTES = [("p", "x", 1), ("p", "y", 2), ("p", "y", 3), ("p", "x", 4), ("q", None, 5), ("q", "", 6), ("q", "z", 7), ("r", "b", 8), ("r", "a", 9)]


MAJORITY = "SELECT 'u' || user_id AS a, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN nullif(event_type, 'click') ELSE event_type END AS b, event_id AS c FROM {t}"


@query(
    f"WITH r AS (SELECT * FROM {values_sql(VOTES)} UNION ALL {MAJORITY.format(t='events')}), n AS (SELECT a, coalesce(nullif(b, ''), 'default') AS b, count(*) AS n, min(c) AS first FROM r GROUP BY 1, 2) "
    "SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, first) AS k FROM n) x WHERE k = 1"
)
def majority_repo(spark, d):
    rows = values(spark, VOTES).union(spark.sql(MAJORITY, t=table(spark, d, "events")))
    return boosts.majority(rows, ["a"], "b", "c")


@query(
    EDGES + ", u AS (SELECT dst AS node, count(*) AS inbound FROM edges WHERE edge_type IN ('calls', 'imports') GROUP BY dst), h AS (SELECT u.node, inbound, name, row_number() OVER (ORDER BY inbound DESC, name, u.node) AS k FROM u JOIN nodes ON u.node = nodes.node "
    "WHERE u.node NOT IN (SELECT src FROM edges WHERE edge_type = 'tested_by' AND src IS NOT NULL)) "
    "SELECT node, inbound, name FROM h WHERE k <= greatest(1, least(round_even((SELECT count(*) FROM u) * 0.10, 0), 50)) AND EXISTS (SELECT 1 FROM edges WHERE edge_type = 'tested_by')"
)
def gated_hotspots(spark, d):
    """With test edges, the hotspots; without any, nothing is added to them."""
    e, n = edges(spark, d), nodes(spark, d).select("node", "name")
    out = boosts.gated_hotspots(e, n).union(boosts.gated_hotspots(e.where("edge_type <> 'tested_by'"), n))
    return out.select("node", "inbound", "name")


KINDS = [(1, "function"), (2, "external"), (3, "file"), (4, "import"), (5, "class")]


NODE_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'external' WHEN 2 THEN 'file' WHEN 3 THEN 'import' WHEN 4 THEN 'class' ELSE lower(p_type) END"


@query(f"SELECT a AS node, b AS kind FROM {values_sql(KINDS)} WHERE a IN (1, 5) UNION ALL SELECT p_partkey + 10, {NODE_KIND} FROM part WHERE p_partkey % 6 IN (0, 4, 5)")
def signal_nodes(spark, d):
    rows = values(spark, KINDS).toDF("node", "kind").union(table(spark, d, "part").selectExpr("p_partkey + 10", NODE_KIND))
    return boosts.signal_nodes(rows)


@query(
    "WITH h AS (SELECT p_partkey, p_brand AS path FROM part ORDER BY p_partkey LIMIT 20) SELECT * FROM h UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 7) AND p_brand NOT IN (SELECT path FROM h)"
)
def capped_with_missing(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_brand AS path", "p_size")
    return boosts.capped_with_missing(p.drop("p_size"), p.where("p_size = 7"), 20, ["p_partkey"])


@query(
    "WITH e AS (SELECT c_custkey AS edge_id, 'n' || (c_custkey % 40) AS target FROM customer), n AS (SELECT DISTINCT 'n' || (p_partkey % 35) AS name FROM part) "
    "SELECT target AS name, 'external' AS kind, count(DISTINCT edge_id) AS n_edges FROM e WHERE target NOT IN (SELECT name FROM n) GROUP BY target"
)
def external_stubs(spark, d):
    e = table(spark, d, "customer").selectExpr("c_custkey AS edge_id", "concat('n', c_custkey % 40) AS target_name")
    n = table(spark, d, "part").selectExpr("p_partkey AS node", "concat('n', p_partkey % 35) AS name", "p_size AS pr")
    linked, stubs = graph.with_stubs(graph.resolve(e, n, F.col("pr")).select("edge_id", "node", "external", "target_name"))
    return stubs.join(linked.select("node"), "node").groupBy("name", "kind").agg(F.count("*").alias("n_edges"))


#: Symbols and calls made from parts: every third part is a test of another's function;
#: after the change, the files of parts whose number modulo 50 is below 10 have other
#: symbols (every second one stays) and calls.
PART_INDEX = (
    "WITH s AS (SELECT p_partkey AS node, CASE p_partkey % 3 WHEN 0 THEN 'test_w' || (p_partkey + 2) ELSE 'w' || p_partkey END AS name, 'function' AS kind, "
    "CASE p_partkey % 3 WHEN 0 THEN 'tests/test_' ELSE 'src/' END || (p_partkey % 50) || '.py' AS path, CAST(NULL AS INT) AS community FROM {part}), "
    "c AS (SELECT p_partkey AS src, p_partkey + 1 AS dst, 'calls' AS edge_type FROM {part} WHERE p_size < 12 UNION ALL SELECT p_partkey, p_partkey + 7, 'calls' FROM {part} WHERE p_brand = 'Brand#11'), "
    "s2 AS (SELECT * FROM s WHERE node % 50 >= 10 OR node % 2 = 0), "
    "c2 AS (SELECT * FROM (SELECT * FROM c WHERE src % 50 >= 10 UNION ALL SELECT node AS src, node + 4 AS dst, 'calls' AS edge_type FROM s2 WHERE node % 50 < 10) x WHERE src IN (SELECT node FROM s2) AND dst IN (SELECT node FROM s2)) "
)
CLOSED = (
    "l AS (SELECT f.node AS src, t.node AS dst FROM {s} t JOIN {s} f ON t.name = 'test_' || f.name WHERE t.node % 3 = 0 AND f.node % 3 <> 0), "
    "g AS (SELECT src, dst FROM {c} UNION SELECT src, dst FROM l), e AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), "
    "r AS (SELECT node, node AS reach FROM {s} UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach JOIN {s} k ON k.node = e.b), m AS (SELECT node, min(reach) AS root FROM r GROUP BY node) "
    "SELECT node, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS community FROM m"
)


#: ``c2`` before calls from and to symbols that are gone are left out.
CALLS_AFTER = "(SELECT * FROM c WHERE src % 50 >= 10 UNION ALL SELECT node AS src, node + 4 AS dst, 'calls' AS edge_type FROM s2 WHERE node % 50 < 10) x"


def part_index(spark, d, symbols, calls):
    """Two of the tables above; of the calls those whose ends are among the
    symbols, by joins with the staged table: ``IN`` over the file of parts would
    send all of its keys through the driver."""
    table(spark, d, "part").createOrReplaceTempView("siftwright_part")
    text = PART_INDEX.format(part="siftwright_part")
    s, c = (staged(spark.sql(text + f"SELECT * FROM {x}"), large=True) for x in (symbols, calls))
    for end in ("src", "dst"):
        c = c.join(s.select(F.col("node").alias(end)), end, "left_semi")
    return s, staged(c.select("src", "dst", "edge_type"), large=True)


def before_change(spark, d):
    return part_index(spark, d, "s", "c")


@query("WITH RECURSIVE " + PART_INDEX.format(part="part")[5:] + ", " + CLOSED.format(s="s", c="c"))
def finalised_index(spark, d):
    """Communities after test links were added, over an index made from parts."""
    return graph.finalised(*before_change(spark, d))[0].select("node", "community")


@query("WITH RECURSIVE " + PART_INDEX.format(part="part")[5:] + ", " + CLOSED.format(s="s2", c="c2"))
def reindexed_components(spark, d):
    """The same after some files were replaced, from the labels before."""
    symbols, edges = before_change(spark, d)
    before = incremental.finish(symbols, edges)
    fresh_s, fresh_c = part_index(spark, d, "s2", CALLS_AFTER)
    paths = symbols.where("node % 50 < 10").select("path").distinct()
    of_paths = fresh_s.join(paths, "path", "left_semi").select(*fresh_s.columns)
    calls = fresh_c.join(of_paths.select(F.col("node").alias("src")), "src", "left_semi").select(*fresh_c.columns)
    after = incremental.replace_files(symbols, edges, paths, of_paths, calls)
    return incremental.refinish(before, *after).symbols.select("node", "community")


#: Edges by name made from line items, and symbols from parts.
NAMED_EDGES = (
    "SELECT l_orderkey * 10 + l_linenumber AS edge_id, 'r' || (l_linenumber % 2) AS repo, 'f' || (l_suppkey % 7) || '/x.py' AS file, CASE l_orderkey % 4 WHEN 0 THEN 'f' || (l_suppkey % 8) || '/x.py' ELSE 'n' || (l_partkey % 60) END AS from_symbol, "
    "'n' || (l_suppkey % 70) AS to_symbol, CASE l_partkey % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'extends' WHEN 2 THEN 'implements' ELSE 'tested_by' END AS edge_type FROM {t}"
)
NAMED_SYMBOLS = (
    "SELECT p_partkey AS node, 'r' || (p_size % 2) AS repo, 'f' || (p_partkey % 7) || '/x.py' AS path, 'n' || (p_partkey % 50) AS name, CASE p_size % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'struct' WHEN 3 THEN 'method' ELSE 'variable' END AS kind, p_size AS line_start FROM {t}"
)


def _tier(end: str, test: str, pick: str) -> str:
    return f"(SELECT {pick} FROM s WHERE s.repo = e.repo AND {test.format(end=end)})"


_CLASSY = "kind IN ('class', 'struct', 'record', 'interface', 'enum')"
_LOCAL, _WIDE = "s.path = e.file AND s.name = e.{end}", "s.name = e.{end}"
_ANY = "min_by(node, CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1000000000 ELSE 2000000000 END + node)"


@query(
    f"WITH e AS ({NAMED_EDGES.format(t='lineitem')}), s AS ({NAMED_SYMBOLS.format(t='part')}), r AS (SELECT edge_id, edge_type, to_symbol, CASE WHEN edge_type <> 'calls' THEN coalesce("
    + _tier("from_symbol", _LOCAL + " AND " + _CLASSY, "max(node)") + ", " + _tier("from_symbol", _WIDE + " AND " + _CLASSY, "min(node)") + ") END AS c, coalesce("
    + _tier("from_symbol", _LOCAL, "max(node)") + ", " + _tier("from_symbol", "s.path = e.{end}", "min_by(node, CAST(line_start AS BIGINT) * 1000000000 + node)") + ", " + _tier("from_symbol", _WIDE, _ANY) + ") AS a, coalesce("
    + _tier("to_symbol", _LOCAL, "max(node)") + ", " + _tier("to_symbol", _WIDE, _ANY) + ") AS b FROM e) "
    "SELECT edge_id, coalesce(c, a) AS src, b AS dst, CASE WHEN b IS NULL THEN to_symbol END AS stub FROM r WHERE coalesce(c, a) IS NOT NULL AND (b IS NOT NULL OR edge_type IN ('extends', 'implements'))"
)
def edge_resolution(spark, d):
    """Edges by name through all tiers, stubs by their names."""
    edges_ = spark.sql(NAMED_EDGES, t=table(spark, d, "lineitem"))
    symbols = spark.sql(NAMED_SYMBOLS, t=table(spark, d, "part"))
    found = resolution.resolve_edges(edges_, symbols)
    stubs = found.stubs.select(F.col("node").alias("n_"), F.col("name").alias("stub"))
    out = found.edges.join(stubs, F.col("dst") == F.col("n_"), "left")
    return out.select("edge_id", "src", F.when(F.col("stub").isNull(), F.col("dst")).alias("dst"), "stub")


@query(
    "WITH e AS (SELECT o_custkey AS src, o_orderkey % 50 AS dst FROM orders), d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) x GROUP BY node ORDER BY n DESC, node LIMIT 10), "
    "k AS (SELECT * FROM e WHERE src IN (SELECT node FROM d) AND dst IN (SELECT node FROM d)) SELECT 'node' AS part, '{\"node\":' || x || ',\"name\":\"n' || x || '\"}' AS json, CAST(1 AS BIGINT) AS n FROM (SELECT src AS x FROM k UNION SELECT dst FROM k) y "
    "UNION ALL SELECT 'edge', '{\"src\":' || src || ',\"dst\":' || dst || ',\"edge_type\":\"calls\"}', count(*) FROM k GROUP BY src, dst"
)
def graph_export(spark, d):
    """Every line of the export, equal lines counted."""
    e = table(spark, d, "orders").selectExpr("o_custkey AS src", "o_orderkey % 50 AS dst", "'calls' AS edge_type")
    n = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("name", F.concat(F.lit("n"), F.col("node").cast("string")))
    return graph.export_json(n, e, 10).groupBy("part", "json").agg(F.count("*").alias("n"))
