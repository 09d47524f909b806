"""Cross-repository links, with languages as repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.operators import reports, workspace
from siftwright.plans.registry import query, table, values, values_sql


IMPORTS = [("web app", "import os\n  from my_lib import x", "my-lib"), ("my-lib", "import my_lib\nfrom web_app.views import y\n# import core", "web app"), ("core", "x = 'import core'\nimport Web_App", "web app"), ("other", "import mylib", None)]


#: A file a part: its repository by brand and size, importing the repository of the
#: next size, sometimes as a comment or in other letters.
MODULES = (
    "SELECT 'Repo-' || (p_size % 9) || ' x' AS repo, CASE p_partkey % 4 WHEN 0 THEN 'import ' WHEN 1 THEN '  from ' WHEN 2 THEN '# import ' ELSE 'FROM ' END || "
    "CASE p_partkey % 2 WHEN 0 THEN 'repo_' ELSE 'REPO_' END || (p_partkey % 11) || '_X' || CASE p_partkey % 3 WHEN 0 THEN '.views' ELSE '' END || ' import y' AS t FROM {t}"
)


@query(
    f"SELECT a AS src_repo, c AS dst_repo FROM {values_sql(IMPORTS)} WHERE c IS NOT NULL UNION ALL SELECT * FROM (WITH m AS (" + MODULES.format(t="part") + "), "
    "n AS (SELECT DISTINCT repo, lower(regexp_extract(t, '^\\s*(?:import|from)\\s+([A-Za-z0-9_]+)', 1)) AS name FROM m), "
    "r AS (SELECT DISTINCT repo, replace(replace(lower(repo), '-', '_'), ' ', '_') AS name FROM m) "
    "SELECT DISTINCT n.repo AS src_repo, r.repo AS dst_repo FROM n JOIN r ON n.name = r.name WHERE n.repo <> r.repo)"
)
def import_links(spark, d):
    rows = spark.sql(MODULES, t=table(spark, d, "part"))
    files = values(spark, IMPORTS).select(F.col("a").alias("repo"), F.col("b").alias("t")).union(rows)
    return workspace.import_links(files, files.select("repo").distinct(), "repo", F.col("t"))


@query("SELECT DISTINCT lang AS src_repo, 'en' AS dst_repo, 'consumes_openapi' AS edge_kind, 0.9::DOUBLE AS confidence FROM (SELECT CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS lang, html FROM pages) x WHERE lang <> 'en' AND regexp_matches(html, '[\"''`]/the[\"''`?/)\\s]')")
def contract_links(spark, d):
    files = table(spark, d, "pages").selectExpr("CASE page_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS lang", "html")
    return workspace.contract_links(files, {"en": ["/the"]}, "lang", "html")


@query(
    "WITH e AS (SELECT l_returnflag AS repo, l_partkey AS src, l_suppkey AS dst FROM lineitem), n AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size % 4 END AS community FROM part) "
    "SELECT repo, count(*) FILTER (WHERE a.community <> b.community) AS n, count(*) FILTER (WHERE a.community <> b.community) > 50 AS coupled FROM e LEFT JOIN n a ON src = a.node LEFT JOIN n b ON dst = b.node GROUP BY repo"
)
def coupling_warning(spark, d):
    e = table(spark, d, "lineitem").selectExpr("l_returnflag AS repo", "l_partkey AS src", "l_suppkey AS dst")
    n = table(spark, d, "part").selectExpr("p_partkey AS node", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size % 4 END AS community")
    return workspace.cross_community_edges(e, n)


@query("SELECT event_id AS id, event_type, CAST(NULL AS VARCHAR) AS source_repo FROM events WHERE user_id % 3 = 0 UNION ALL SELECT event_id, event_type, 'r' || (user_id % 3) FROM events WHERE user_id % 3 > 0 AND event_id % 2 = 0")
def federated_notes(spark, d):
    e = table(spark, d, "events").selectExpr("event_id AS id", "event_type", "concat('r', user_id % 3) AS source_repo")
    siblings = e.where("source_repo <> 'r0'")
    return workspace.federated(e.where("source_repo = 'r0'").drop("source_repo"), siblings, siblings.where("id % 2 = 0"))


FILES = [("src/Foo.java", "a/footest.java"), ("src/Foo.java", "a/FooTests.java"), ("b/x.py", "t/test_x.py"), ("b/x.py", "t/X_TEST.py"), ("c/Y.cs", "c/YTests.cs")]
UNMATCHED = [("d/z.go", "d/z_test.go"), ("d/Foo.cs", "d/test_Foo.cs"), ("d/q.py", "d/test_q.java")]


#: A source file and a file named like its test for each part; every third one breaks
#: the convention.
PAIRS = (
    "SELECT p_partkey, 'src/Part' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.py' ELSE '.java' END AS source, 't/' || CASE p_partkey % 6 WHEN 0 THEN 'test_PART' || p_partkey || '.py' WHEN 1 THEN 'part' || p_partkey || 'Tests.java' "
    "WHEN 2 THEN 'part' || p_partkey || '_TEST.py' WHEN 3 THEN 'PART' || p_partkey || 'test.java' WHEN 4 THEN 'test_part' || p_partkey || '.java' ELSE 'test_part' || p_partkey || '.java' END AS test FROM {t}"
)


@query(f"SELECT a AS source, b AS test FROM {values_sql(FILES)} UNION ALL SELECT source, test FROM (" + PAIRS.format(t="part") + ") x WHERE p_partkey % 6 < 4")
def stem_test_files(spark, d):
    every = values(spark, FILES + UNMATCHED)
    pairs = spark.sql(PAIRS, t=table(spark, d, "part"))
    sources = every.select(F.col("a").alias("path")).union(pairs.select("source")).distinct()
    return workspace.test_files(sources, every.select(F.col("b").alias("path")).union(pairs.select("test")).distinct())


CHANGED_TESTS = [("t/test_x.py", True), ("t/y_test.py", True), ("t/x.py", False), ("t/test_z.py", False), ("t/test_x_test.py", False)]


#: Test files of parts, of which those of size below 20 have changed.
TESTS = "SELECT 't/' || CASE p_partkey % 3 WHEN 0 THEN 'test_p' || p_partkey WHEN 1 THEN 'p' || p_partkey || '_test' ELSE 'p' || p_partkey END || '.py' AS path, 'src/p' || p_partkey || '.go' AS source, p_size FROM {t}"


@query(
    f"SELECT a AS path FROM {values_sql(CHANGED_TESTS)} WHERE b UNION ALL SELECT t.path FROM ({TESTS.format(t='part')}) t WHERE "
    "(regexp_matches(t.path, '^t/test_') OR regexp_matches(t.path, '_test[.]py$')) AND t.p_size < 20"
)
def tests_of_changed(spark, d):
    rows = spark.sql(TESTS, t=table(spark, d, "part"))
    changed = values(spark, [("src/x.py",), ("lib/y.go",)]).select(F.col("a").alias("path")).union(rows.where("p_size < 20").select("source"))
    return workspace.tests_of_changed(values(spark, CHANGED_TESTS).select(F.col("a").alias("path")).union(rows.select("path")), changed)


@query("SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def edges_of_group(spark, d):
    wanted = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("node"))
    return reports.edges_from(table(spark, d, "lineitem"), wanted, "l_orderkey").select("l_shipdate", "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, min(p) AS part FROM (SELECT o_orderkey, 'hit' AS p FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'late' FROM orders) x GROUP BY o_orderkey")
def ordered_union(spark, d):
    from siftwright.operators import memory

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    a = o.where("o_orderstatus = 'F'").withColumn("part", F.lit("hit")).withColumn("k", F.lit(0))
    b = o.withColumn("part", F.lit("late")).withColumn("k", F.lit(1))
    return memory.latest_per_key(a.unionByName(b), ["o_orderkey"], [F.asc("k")]).select("o_orderkey", "part")


@query(
    "SELECT c_custkey, 'kept' AS part FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END FROM orders WHERE o_orderkey % 2 = 0) "
    "UNION ALL SELECT c_custkey, 'null' FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END FROM orders)"
)
def null_aware_anti(spark, d):
    """A null among the excluded keys leaves nothing; without one, it's an anti join."""
    known, nulls = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS k FROM {o} WHERE o_orderkey % 2 = 0", "SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS k FROM {o}"
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    some = spark.sql("SELECT c_custkey, 'kept' AS part FROM {c} WHERE c_custkey NOT IN (" + known + ")", c=c, o=o)
    return some.union(spark.sql("SELECT c_custkey, 'null' AS part FROM {c} WHERE c_custkey NOT IN (" + nulls + ")", c=c, o=o))


@query("SELECT n_name, s_suppkey FROM (SELECT n_name, s_suppkey, row_number() OVER (PARTITION BY n_name ORDER BY CASE WHEN s_acctbal > 5000 THEN 0 WHEN s_acctbal > 1000 THEN 1 ELSE 2 END, s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey) x WHERE k = 1")
def priority_pick(spark, d):
    from siftwright.operators import memory

    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    tier = F.when(F.col("s_acctbal") > 5000, 0).when(F.col("s_acctbal") > 1000, 1).otherwise(2)
    return memory.latest_per_key(s, ["n_name"], [tier.asc(), F.asc("s_suppkey")]).select("n_name", "s_suppkey")
