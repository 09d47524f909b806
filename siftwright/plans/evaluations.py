"""Retrieval quality over benchmark passages and line items."""

from __future__ import annotations

from pyspark.sql import functions as F


from siftwright.operators import evaluation, memory, ranking, reports
from siftwright.plans.registry import query, table, values, values_sql

#: Gold and returned id lists by customer: orders of two kinds.
LISTS = "WITH t AS (SELECT o_custkey AS task, list_sort(list(o_orderkey % 50) FILTER (WHERE o_orderstatus = 'F')) AS g, list_sort(list(o_orderkey % 50) FILTER (WHERE o_orderpriority < '3')) AS r FROM orders GROUP BY o_custkey), l AS (SELECT task, list_sort(list_distinct(coalesce(g, []))) AS gold, list_sort(list_distinct(coalesce(r, []))) AS got FROM t), " 
HITS = "m AS (SELECT task, gold, got, len(list_filter(gold, lambda x: list_contains(got, x))) AS hits FROM l), "
PRF = HITS + (
    "p AS (SELECT task, gold, got, hits, CASE WHEN len(gold) = 0 AND len(got) = 0 THEN 1.0 WHEN len(got) = 0 THEN 0.0 ELSE hits / len(got) END AS p, CASE WHEN len(gold) = 0 AND len(got) = 0 THEN 1.0 WHEN len(gold) = 0 THEN 0.0 ELSE hits / len(gold) END AS r FROM m), "
    "f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM p) "
)


def lists(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey") % 50)
    return o.groupBy(F.col("o_custkey").alias("task")).agg(
        F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("k")))).alias("gold"),
        F.array_sort(F.collect_set(F.when(F.col("o_orderpriority") < "3", F.col("k")))).alias("got"),
    )


@query(LISTS + "z AS (SELECT task, gold, list_slice(got, 1, 5) AS top FROM l) SELECT task, len(list_filter(gold, lambda x: NOT list_contains(top, x))) = 0 AS hit, len(list_filter(gold, lambda x: NOT list_contains(top, x))) AS n_missing FROM z")
def recall_at_k(spark, d):
    x = lists(spark, d)
    return x.select("task", evaluation.all_in_top_k(F.col("gold"), F.col("got"), 5).alias("hit"), F.size(evaluation.missing_of(F.col("gold"), F.col("got"), 5)).cast("long").alias("n_missing"))


@query(LISTS + PRF + "SELECT task, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1 FROM f")
def prf(spark, d):
    return evaluation.with_prf(lists(spark, d), "gold", "got").select("task", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])


@query(
    LISTS + PRF + ", j AS (SELECT c_nationkey AS repo, p, r, f1 FROM f JOIN customer ON task = c_custkey) "
    "SELECT repo, count(*) AS tasks, round(avg(p), 6) AS avg_p, round(avg(r), 6) AS avg_r, round(avg(f1), 6) AS avg_f1 FROM j GROUP BY repo UNION ALL SELECT NULL, count(*), round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6) FROM j"
)
def macro_by_repo(spark, d):
    x = evaluation.with_prf(lists(spark, d), "gold", "got").join(table(spark, d, "customer").selectExpr("c_custkey AS task", "c_nationkey AS repo"), "task")
    return evaluation.macro(x, "repo", ["p", "r", "f1"]).select("repo", "tasks", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in ("p", "r", "f1")])


@query("SELECT doc_id, round(CASE WHEN n_chars // 4 - 10 <= 0 THEN 0 ELSE 0.5 / (n_chars // 4 - 10) * 1000 END, 6) AS efficiency, greatest(1, CAST(floor((n_chars % 40) * 30.5 / 4) AS BIGINT)) AS read_cost FROM documents")
def token_efficiency(spark, d):
    x = table(spark, d, "documents")
    return x.select(
        "doc_id", F.round(evaluation.token_efficiency(F.lit(0.5), F.expr("n_chars div 4 - 10")), 6).alias("efficiency"),
        evaluation.read_cost(F.col("n_chars") % 40, F.lit(30.5)).alias("read_cost"),
    )


@query(
    "WITH g AS (SELECT event_type, user_id % 300 AS u, count(value) AS runs, avg(value) AS mean, stddev_samp(value) AS sd FROM events GROUP BY 1, 2) "
    "SELECT event_type, u, runs, round(mean, 3) AS mean, CASE WHEN runs >= 10 THEN round(mean - 1.96 * sd / sqrt(runs), 3) END AS low, CASE WHEN runs >= 10 THEN round(mean + 1.96 * sd / sqrt(runs), 3) END AS high FROM g"
)
def ci95(spark, d):
    return evaluation.ci95(table(spark, d, "events").withColumn("u", F.col("user_id") % 300), ["event_type", "u"], "value")


@query(
    "SELECT user_id, count(*) AS runs, count(*) FILTER (WHERE value >= 20) AS successes, round(avg(value), 6) AS mean_latency, round(stddev_samp(value), 4) AS sd_latency, max_by(event_type, event_id) FILTER (WHERE value >= 20) AS event_type FROM events GROUP BY user_id"
)
def run_aggregate(spark, d):
    out = evaluation.aggregate_runs(table(spark, d, "events"), ["user_id"], "event_id", F.col("value") >= 20, "value", ["event_type"])
    return out.select("user_id", "runs", "successes", F.round("mean_latency", 6).alias("mean_latency"), F.round("sd_latency", 4).alias("sd_latency"), "event_type")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE round(100.0 * (o_totalprice - (o_orderkey % 10) * 10000) / ((o_orderkey % 10) * 10000), 1) END AS delta FROM orders")
def signed_deltas(spark, d):
    base = (F.col("o_orderkey") % 10) * 10000
    return table(spark, d, "orders").select("o_orderkey", evaluation.signed_delta(F.col("o_totalprice"), base).alias("delta"))


@query("SELECT lang, round(100.0 * (sum(n_chars // 4 + 40) - sum(CASE WHEN doc_id % 3 = 0 THEN n_chars // 4 + 40 ELSE 0 END)) / sum(n_chars // 4 + 40), 1) AS reduction FROM documents GROUP BY lang")
def reduction_pct(spark, d):
    est = F.expr("n_chars div 4 + 40")
    g = table(spark, d, "documents").groupBy("lang").agg(F.sum(est).alias("b"), F.sum(F.when(F.col("doc_id") % 3 == 0, est).otherwise(0)).alias("k"))
    return g.select("lang", ranking.reduction_pct(F.col("b"), F.col("k")).alias("reduction"))


@query(
    "SELECT p_brand, contains(string_agg(lower(p_name), '|' ORDER BY p_name), 'green') AS hit, round(avg(CASE WHEN p_retailprice >= 1000 THEN 1.0 ELSE 0.0 END), 6) AS rank_quality FROM part GROUP BY p_brand"
)
def hit_rate(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("titles"), evaluation.rank_quality(F.col("p_retailprice"), 1000).alias("q"))
    return g.select("p_brand", evaluation.any_contains(F.col("titles"), F.lit("Green")).alias("hit"), F.round("q", 6).alias("rank_quality"))


@query(
    LISTS + PRF + ", c AS (SELECT f1, CASE WHEN task % 3 = 0 THEN 1.0 ELSE f1 END AS g1, len(got) / greatest(1, len(gold)) AS ratio FROM f) SELECT 'all' AS suite, round(avg(f1), 6) AS avg_f1, round(avg(ratio), 6) AS avg_ratio, avg(f1) >= 0.8 AND avg(ratio) >= 1.0 AS passed FROM c "
    "UNION ALL SELECT 'good', round(avg(g1), 6), round(avg(ratio), 6), avg(g1) >= 0.8 AND avg(ratio) >= 1.0 FROM c WHERE g1 = 1.0"
)
def quality_gate(spark, d):
    x = evaluation.with_prf(lists(spark, d), "gold", "got").withColumn("ratio", F.size("got") / F.greatest(F.lit(1), F.size("gold")))
    good = x.withColumn("f1", F.when(F.col("task") % 3 == 0, 1.0).otherwise(F.col("f1"))).where("f1 = 1.0")
    parts = [evaluation.gate(y, "f1", "ratio").select(F.lit(n).alias("suite"), F.round("avg_f1", 6).alias("avg_f1"), F.round("avg_ratio", 6).alias("avg_ratio"), "passed") for n, y in (("all", x), ("good", good))]
    return parts[0].unionByName(parts[1])


@query("SELECT item_id, count(doc_id) AS gold_docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id")
def gold_documents(spark, d):
    """Documents that hold a benchmark passage, for evaluation sets."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    hits = evaluation.holding(table(spark, d, "documents").select("doc_id", "text"), b).groupBy("item_id").agg(F.count("*").alias("gold_docs"))
    return b.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("gold_docs", F.lit(0)).alias("gold_docs"))


TASKS = "SELECT l_returnflag AS suite, l_linestatus = 'O' AS success, CAST(l_discount * 100 AS DOUBLE) AS reduction_pct, CAST(l_quantity AS DOUBLE) AS latency_ms, CAST(l_quantity * 10 AS DOUBLE) AS est_tokens, CASE WHEN l_linenumber > 3 THEN 0.5 ELSE 0.0 END AS hit_rate, CASE WHEN l_linenumber = 2 THEN 0.25 ELSE 0.0 END AS random_hit_rate, l_linenumber / 7.0 AS rank_quality FROM {t}"


@query(
    "WITH t AS (" + TASKS.format(t="lineitem") + "), r AS (SELECT *, success AND (hit_rate > 0 OR random_hit_rate > 0) AS rated FROM t) "
    "SELECT count(*) AS total_tasks, round(100.0 * count(*) FILTER (WHERE success) / count(*), 1) AS success_rate, round(avg(reduction_pct) FILTER (WHERE success), 1) AS avg_reduction_pct, "
    "round(avg(reduction_pct) FILTER (WHERE success) - 1.96 * stddev_samp(reduction_pct) FILTER (WHERE success) / sqrt(count(*) FILTER (WHERE success)), 1) AS reduction_ci_low, "
    "round(avg(reduction_pct) FILTER (WHERE success) + 1.96 * stddev_samp(reduction_pct) FILTER (WHERE success) / sqrt(count(*) FILTER (WHERE success)), 1) AS reduction_ci_high, "
    "round(avg(latency_ms), 1) AS avg_latency_ms, round_even(avg(est_tokens) FILTER (WHERE success), 0) AS avg_est_tokens, round(avg(hit_rate) FILTER (WHERE rated), 3) AS avg_hit_rate, "
    "round(avg(random_hit_rate) FILTER (WHERE rated), 3) AS avg_random_hit_rate, round(avg(rank_quality) FILTER (WHERE success), 3) AS avg_rank_quality FROM r"
)
def run_summary(spark, d):
    return evaluation.summary(spark.sql(TASKS, t=table(spark, d, "lineitem")))


FIRST = [("a", "src/x.py", "x.py|y.py", True), ("a", "x.py", "lib/x.py", True), ("a", "max.py", "x.py", False), ("b", "y.py", "x.py|y.py", True), ("b", None, "x.py", False)]


#: First result and gold paths of an order's lines: the first line's part, as a bare
#: name or below a folder, against the parts of its other lines.
RANKED = (
    "SELECT l_returnflag AS repo, (CASE l_linenumber % 2 WHEN 1 THEN 'src/' ELSE '' END) || 'f' || (l_partkey % 5) || '.py' AS got, "
    "(CASE l_suppkey % 3 WHEN 1 THEN 'lib/' WHEN 2 THEN 'src/' ELSE '' END) || 'f' || (l_suppkey % 4) || '.py' AS g1, 'xf' || (l_partkey % 5) || '.py' AS g2 FROM {t}"
)


@query(
    "WITH r AS (" + RANKED.format(t="lineitem") + "), h AS (SELECT repo, got = g1 OR ends_with(got, '/' || g1) OR ends_with(g1, '/' || got) OR got = g2 OR ends_with(got, '/' || g2) OR ends_with(g2, '/' || got) AS hit FROM r) "
    f"SELECT repo, count(*) AS tasks, count(*) FILTER (WHERE hit) AS rank1 FROM h GROUP BY repo UNION ALL SELECT a, count(*), count(*) FILTER (WHERE d) FROM {values_sql(FIRST)} GROUP BY a"
)
def rank_one_hits(spark, d):
    cases = values(spark, FIRST).select(F.col("a").alias("repo"), F.split("c", "[|]").alias("gold"), F.when(F.col("b").isNotNull(), F.array("b")).otherwise(F.array().cast("array<string>")).alias("got"))
    rows = spark.sql(RANKED, t=table(spark, d, "lineitem")).select("repo", F.array("g1", "g2").alias("gold"), F.array("got").alias("got"))
    return evaluation.rank_one_hits(cases.union(rows), ["repo"], "gold", "got")


@query(
    "WITH r AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY md5('7|' || p_name), p_name) AS k FROM part) "
    "SELECT p_brand, max(CASE WHEN contains(lower(p_name), 'blue') THEN 1.0::DOUBLE ELSE 0.0 END) AS random_hit_rate FROM r WHERE k <= 5 GROUP BY p_brand"
)
def random_baseline(spark, d):
    """A seeded draw by a hash of the titles."""
    return evaluation.random_hits(table(spark, d, "part").select("p_brand", "p_name"), ["p_brand"], 5, "p_name", F.lit("blue"))


@query(
    "SELECT event_type, count(*) FILTER (WHERE user_id % 7 > 0 AND user_id % 5 < 2) AS committed, count(*) FILTER (WHERE user_id % 7 > 0 AND user_id % 5 = 2) AS staged, count(*) FILTER (WHERE user_id % 7 = 0) AS federated FROM events GROUP BY event_type"
)
def provenance_counts(spark, d):
    """Notes by where their files are known from, and those of other repositories."""
    notes = table(spark, d, "events").selectExpr("event_type", "concat('f', user_id % 5) AS path", "user_id % 7 = 0 AS other")
    known = lambda k: spark.range(5).selectExpr("concat('f', id) AS path").where(k)
    told = memory.provenance(notes, known("path < 'f2'"), known("path = 'f2'"), "path")
    return reports.provenance_counts(told, ["event_type"], federated=F.col("other"))
