"""Whole packs by mode, and what hangs on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.operators import cache, graph, packs, reports
from siftwright.plans import graphs
from siftwright.plans.ranking import COLUMNS, NORMAL, items
from siftwright.plans.registry import QUERIES, SQL, query, table
from siftwright.plans.retrieval import BM25, QUERY

FLOOR = {"review": (0.55, 0.30), "implement": (0.55, 0.30), "minimal": (0.55, 0.30), "debug": (0.0, 0.30), "handover": (0.0, 0.20)}


def pack_sql(mode: str) -> str:
    share, least = FLOOR[mode]
    budget, sure = packs.BUDGETS[mode], packs.GUARANTEED[mode]
    kind = f"kind IN ({', '.join(repr(k) for k in sure)})" if sure else "false"
    fits = lambda used, t, k, seen: f"({used} + {t} <= {budget} OR ({k} AND NOT {seen}))"
    take1, take2 = fits("0", "est_tokens", kind, "false"), fits("f.used", "r.est_tokens", kind.replace("kind", "r.kind"), "f.seen")
    last = "tk" if mode not in ("review", "implement") else "a"
    return (
        "WITH RECURSIVE " + BM25.strip()[5:] + f", items AS (SELECT {COLUMNS} FROM documents), "
        "sc AS (SELECT items.* REPLACE (round(least(0.95, 0.6 * confidence + 0.4 * bm25), 6) AS confidence) FROM items JOIN b ON ord = b.doc_id), "
        f"u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, source, title, {NORMAL} ORDER BY confidence DESC, ord) AS k1 FROM sc) x WHERE k1 = 1), "
        f"fl AS (SELECT * FROM (SELECT *, max(confidence) OVER (PARTITION BY repo, source) AS top, row_number() OVER (PARTITION BY repo, source ORDER BY confidence DESC, ord) AS k2 FROM u) x WHERE confidence >= greatest({share} * top, {least}) - 1e-9 OR k2 = 1), "
        "rr AS (SELECT repo, source, ord, kind, confidence, est_tokens, row_number() OVER (PARTITION BY repo, source ORDER BY confidence / greatest(1, est_tokens) DESC, confidence DESC, ord) AS i FROM fl), "
        f"f AS (SELECT repo, source, i, ord, confidence, {take1} AS take, CASE WHEN {take1} THEN est_tokens ELSE 0 END AS used, ({kind}) AS seen FROM rr r WHERE i = 1 "
        f"UNION ALL SELECT r.repo, r.source, r.i, r.ord, r.confidence, {take2}, CASE WHEN {take2} THEN f.used + r.est_tokens ELSE f.used END, (f.seen OR ({kind.replace('kind', 'r.kind')} AND {take2})) FROM f JOIN rr r ON r.repo = f.repo AND r.source = f.source AND r.i = f.i + 1), "
        "tk AS (SELECT repo, source, ord, confidence FROM f WHERE take), "
        "w AS (SELECT *, row_number() OVER (PARTITION BY repo, source ORDER BY confidence DESC, ord) AS k3, lag(confidence) OVER (PARTITION BY repo, source ORDER BY confidence DESC, ord) AS prev, max(confidence) OVER (PARTITION BY repo, source) AS best FROM tk), "
        "c AS (SELECT *, min(CASE WHEN best > 0.4 AND confidence < 0.4 AND prev - confidence < 0.02 THEN k3 END) OVER (PARTITION BY repo, source) AS cut FROM w), "
        "a AS (SELECT repo, source, ord, confidence FROM c WHERE confidence >= 0.6 * best AND (cut IS NULL OR k3 < cut)) "
        f"SELECT * FROM (SELECT repo, source, ord, confidence, CAST(row_number() OVER (PARTITION BY repo, source ORDER BY confidence DESC, ord) AS INTEGER) AS rank FROM {last}) z" + (" WHERE rank <= 5" if mode == "minimal" else "")
    )


def pack_query(mode: str):
    return lambda spark, d: packs.build_pack(items(spark, d, "text"), QUERY, mode, ["repo", "source"], F.col("text"))


for _mode in packs.BUDGETS:
    QUERIES[f"full_pack_{_mode}"] = pack_query(_mode)
    SQL[f"full_pack_{_mode}"] = pack_sql(_mode)


@query(pack_sql("review"))
def cached_pack(spark, d):
    """A pack from the cache: built and stored by the first call, and read by the
    second, which may not build anything."""
    docs = table(spark, d, "documents")
    store = cache.ResultCache(spark, graph.shared_path(spark, "packs"))
    key = cache.key_of("review", QUERY, packs.BUDGETS["review"], cache.fingerprint(docs))
    store.get_or_build("all", key, lambda: QUERIES["full_pack_review"](spark, d))

    def never():
        raise RuntimeError("the second call must be a hit")

    return store.get_or_build("all", key, never)


@query(
    f"WITH items AS (SELECT {COLUMNS} FROM documents), m AS (SELECT *, CASE WHEN ord % 4 = 0 THEN NULL ELSE ord % 3 END AS community FROM items), "
    "a AS (SELECT repo, community AS anchor FROM (SELECT repo, community, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, ord) AS k FROM m WHERE community IS NOT NULL) x WHERE k = 1) "
    "SELECT ord, round(CASE WHEN community = anchor THEN least(1.0, confidence + 0.10) ELSE confidence END, 6) AS confidence FROM m JOIN a ON m.repo = a.repo"
)
def community_anchor(spark, d):
    i = items(spark, d).withColumn("community", F.when(F.col("ord") % 4 != 0, F.col("ord") % 3))
    return packs.community_anchor(i, ["repo"]).select("ord", F.round("confidence", 6).alias("confidence"))


@query("SELECT l_orderkey AS stub, min(l_returnflag) AS file FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1")
def external_resolve(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("stub"), F.col("l_returnflag").alias("file"))
    return packs.external_resolved(e.select("stub").distinct(), e)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def newest_packs(spark, d):
    return packs.newest_packs(table(spark, d, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey")


def some_flows(spark, d):
    return graph.flows(graphs.sparse(spark, d), graphs.entries(spark, d), max_depth=4)


FLOWS = graphs.SPARSE[5:] + (
    "s AS (SELECT DISTINCT src, dst FROM sp), f AS (SELECT src AS entry, src AS at, [src] AS path FROM s WHERE src NOT IN (SELECT dst FROM s) GROUP BY src "
    "UNION ALL SELECT f.entry, s.dst, list_append(f.path, s.dst) FROM f JOIN s ON s.src = f.at WHERE NOT list_contains(f.path, s.dst) AND len(f.path) <= 4), "
    "x AS (SELECT f.entry, f.at AS leaf, f.path FROM f WHERE len(f.path) > 1 AND (len(f.path) = 5 OR NOT EXISTS (SELECT 1 FROM s WHERE s.src = f.at AND NOT list_contains(f.path, s.dst)))), "
    "y AS (SELECT entry, leaf, path FROM (SELECT *, row_number() OVER (PARTITION BY entry, leaf ORDER BY len(path), path) AS k FROM x) z WHERE k = 1) "
)


@query("WITH RECURSIVE " + FLOWS + "SELECT entry, leaf FROM y WHERE list_contains(path, (SELECT min(dst) FROM s))")
def affected_flows(spark, d):
    node = graphs.sparse(spark, d).agg(F.min("dst")).first()[0]
    return packs.affected_flows(some_flows(spark, d), node).select("entry", "leaf")


@query(
    "WITH RECURSIVE " + FLOWS + ", n AS (SELECT unnest(path) AS node, len(path) AS l, entry, leaf FROM y), g AS (SELECT node, entry, leaf, row_number() OVER (PARTITION BY node ORDER BY l, entry, leaf) AS k FROM n) "
    "SELECT p_partkey, CASE WHEN entry IS NOT NULL THEN entry || '>' || leaf END AS flow FROM part LEFT JOIN g ON p_partkey = node AND k = 1"
)
def debug_flow_labels(spark, d):
    p = table(spark, d, "part").select("p_partkey")
    return packs.flow_label(p, some_flows(spark, d), "p_partkey").select("p_partkey", "flow")


@query("SELECT lang AS repo, CAST(sum(CASE WHEN n = 0 THEN 0 ELSE greatest(1, n // 4) END + 40) AS BIGINT) AS naive_tokens FROM (SELECT lang, length(coalesce(text, '')) AS n FROM documents) x GROUP BY lang")
def naive_baseline(spark, d):
    return reports.naive_tokens(table(spark, d, "documents").withColumnRenamed("lang", "repo"), ["repo"], F.col("text"))


@query(
    "SELECT c_nationkey AS community, count(*) AS members, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT CAST(c_custkey AS BIGINT) AS k FROM customer i WHERE i.c_nationkey = o.c_nationkey ORDER BY c_custkey LIMIT 20) x) AS first FROM customer o GROUP BY c_nationkey"
)
def community_members(spark, d):
    found = reports.members(table(spark, d, "customer").select(F.col("c_nationkey").alias("community"), F.col("c_custkey").alias("node")), shown=20)
    return found.select("community", "members", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ",").alias("first"))


@query(
    "SELECT count(*) FILTER (WHERE n = 1) AS resolved, count(*) FILTER (WHERE n IS NULL OR n <> 1) AS dropped FROM (SELECT o_orderkey FROM orders) o LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem WHERE l_quantity < 40 GROUP BY l_orderkey) l ON o_orderkey = l_orderkey"
)
def external_dropped(spark, d):
    refs = table(spark, d, "lineitem").where("l_quantity < 40").select(F.col("l_orderkey").alias("stub"), F.col("l_returnflag").alias("file"))
    return packs.external_dropped(table(spark, d, "orders").select(F.col("o_orderkey").alias("stub")), refs)


@query(
    "WITH i AS (SELECT lang, source, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a>b' WHEN doc_id % 3 = 1 THEN '' END AS flow, row_number() OVER (PARTITION BY lang, source ORDER BY round((doc_id * 37 % 100) / 100.0, 2) DESC, doc_id) AS k FROM documents), "
    "g AS (SELECT lang AS repo, source, count(nullif(flow, '')) AS w, count(*) AS n FROM i WHERE k <= 5 GROUP BY lang, source) "
    "SELECT repo, source, CASE WHEN w < 3 THEN 'flows available for only ' || w || ' of top ' || n || ' items; consider re-indexing or widening the query' END AS note FROM g"
)
def debug_flow_note(spark, d):
    flow = F.when(F.col("ord") % 3 == 0, "a>b").when(F.col("ord") % 3 == 1, "")
    return packs.flow_note(items(spark, d).withColumn("flow", flow), ["repo", "source"])
