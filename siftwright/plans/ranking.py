"""Classifiers and the candidate chain: floor, dedup, budget, top-k, cutoffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions import scores

from siftwright.operators import candidates, classify, ranking, reports, sinks, workspace
from siftwright.plans.registry import query, table, values, values_sql
from siftwright.plans.retrieval import CONF, PATH

KIND = "CASE doc_id % 6 WHEN 0 THEN 'changed_file' WHEN 1 THEN 'blast_radius' WHEN 2 THEN 'impacted_test' WHEN 3 THEN 'config' WHEN 4 THEN 'memory' ELSE 'file' END"
TITLE = "substr(text, 1, 4) || '(' || (doc_id % 3) || ')'"
COLUMNS = f"doc_id, doc_id AS ord, lang AS repo, source, {PATH} AS path, {TITLE} AS title, substr(text, 1, 12) AS excerpt, {KIND} AS kind, CAST({CONF} AS DOUBLE) AS confidence, greatest(1, n_chars // 4) + 40 AS est_tokens"
ITEMS = f"WITH items AS (SELECT {COLUMNS} FROM documents) "


def items(spark, d, *more):
    return table(spark, d, "documents").selectExpr(*[c.strip() for c in split_columns(COLUMNS.replace("//", "div"))], *more)


def split_columns(text):
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


@query(
    ITEMS + "SELECT ord, category, round(least(0.95, w * CASE WHEN category = 'changed_file' THEN CASE WHEN path LIKE 'tests/%' THEN 0.85 ELSE 1.15 END ELSE 1 END), 6) AS confidence FROM "
    "(SELECT *, CASE category WHEN 'changed_file' THEN 0.95 WHEN 'blast_radius' THEN 0.70 WHEN 'impacted_test' THEN 0.60 WHEN 'config' THEN 0.25 WHEN 'query_match' THEN 0.55 ELSE 0.20 END AS w FROM "
    "(SELECT *, CASE WHEN ord % 7 = 0 THEN 'changed_file' WHEN ord % 5 = 0 THEN 'blast_radius' WHEN kind = 'impacted_test' THEN 'impacted_test' WHEN kind = 'config' THEN 'config' WHEN contains(title, 'T') THEN 'query_match' ELSE 'file' END AS category FROM items) a) b"
)
def review_classify(spark, d):
    i = items(spark, d)
    cat = classify.review(F.col("ord") % 7 == 0, F.col("ord") % 5 == 0, F.col("kind") == "impacted_test", F.col("kind") == "config", F.contains("title", F.lit("T")))
    out = i.withColumn("category", cat).withColumn("w", classify.weight_of(F.col("category"), classify.REVIEW))
    return out.select("ord", "category", F.round(classify.changed_prior(F.col("category"), F.col("w"), F.col("path")), 6).alias("confidence"))


NAMED = [
    ("run", "function", "src/app.py", "entrypoint"), ("Main", "method", "src/prefix.py", "entrypoint"), ("run", "function", "fixtures/app.py", "entrypoint"), ("run", "function", "src/conftest.py", "function"),
    ("run", "function", "src/test_app.py", "function"), ("app", "function", "db/migrate_1.py", "function"), ("serve", "function", "src/models.py", "entrypoint"), ("runner", "function", "a/model_x.py", "contract"),
    ("Thing", "class", "a/Interfaces.py", "contract"), ("MyBase", "class", "a/b.py", "extension_point"), ("abstractThing", "class", "a/b.py", "extension_point"), ("Thing", "class", "a/b.py", "class"),
    ("run", "class", "a/b.py", "class"), ("x", "constant", "a/b.py", "file"),
]


#: Symbols made from parts, by the words of their names and their sizes.
PART_SYMBOLS = (
    "SELECT CASE p_partkey % 5 WHEN 0 THEN 'run' WHEN 1 THEN 'My' || p_type || 'Base' WHEN 2 THEN 'SERVE' ELSE p_name END AS name, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'class' ELSE 'constant' END AS kind, "
    "CASE p_partkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'schemas/' ELSE 'lib/' END || CASE p_partkey % 7 WHEN 0 THEN 'Conftest' WHEN 1 THEN 'do_fix' WHEN 2 THEN 'my_MODEL' ELSE 'part' END || p_partkey || '.py' AS path FROM {t}"
)


@query(
    f"SELECT a AS name, b AS kind, c AS path, d AS category FROM {values_sql(NAMED)} UNION ALL SELECT name, kind, path, "
    "CASE WHEN kind IN ('function', 'method') AND lower(name) IN ('run', 'serve') AND NOT regexp_matches(lower(path), '(conftest|_fix)[^/]*$') THEN 'entrypoint' WHEN contains(lower(path), 'schema') OR contains(lower(path), 'model') THEN 'contract' "
    "WHEN kind = 'class' AND contains(lower(name), 'base') THEN 'extension_point' WHEN kind = 'class' THEN 'class' WHEN kind IN ('function', 'method') THEN 'function' ELSE 'file' END FROM (" + PART_SYMBOLS.format(t="part") + ") x"
)
def implement_classify(spark, d):
    s = values(spark, NAMED).toDF("name", "kind", "path", "want").drop("want").union(spark.sql(PART_SYMBOLS, t=table(spark, d, "part")))
    return s.select("name", "kind", "path", classify.implement(F.col("name"), F.col("kind"), F.col("path")).alias("category"))


@query(
    ITEMS + "SELECT ord, CASE WHEN ord % 11 = 0 THEN 'runtime_signal' WHEN ord % 9 = 0 THEN 'past_debug' WHEN kind = 'changed_file' THEN 'changed_file' WHEN kind = 'impacted_test' THEN 'failing_test' WHEN kind = 'blast_radius' THEN 'blast_radius' ELSE 'file' END AS category FROM items"
)
def debug_classify(spark, d):
    cat = classify.debug(F.col("ord") % 11 == 0, F.col("ord") % 9 == 0, F.col("kind") == "changed_file", F.col("kind") == "impacted_test", F.col("kind") == "blast_radius")
    return items(spark, d).select("ord", cat.alias("category"))


@query(
    ITEMS + "SELECT 'code' AS part, CAST(ord AS VARCHAR) AS id, CASE WHEN kind = 'changed_file' THEN 'changed_file' WHEN kind = 'blast_radius' THEN 'blast_radius' ELSE 'file' END AS kind, "
    "round(CASE kind WHEN 'changed_file' THEN least(0.95, 0.90 * CASE WHEN path LIKE 'tests/%' THEN 0.85 ELSE 1.15 END) WHEN 'blast_radius' THEN 0.50 ELSE 0.15 END, 6) AS confidence FROM items WHERE kind <> 'memory' "
    "UNION ALL SELECT 'memory', CAST(ord AS VARCHAR), 'memory', round(greatest(0.10, least(0.80, confidence)), 6) FROM items WHERE kind = 'memory' "
    "UNION ALL SELECT 'decision', CAST(event_id AS VARCHAR), 'decision', round(greatest(0.10, least(0.75, value / 100.0)), 6) FROM events WHERE event_type <> 'error'"
)
def handover_union(spark, d):
    i = items(spark, d)
    code = i.where("kind <> 'memory'").select(F.col("ord").alias("id"), "path", (F.col("kind") == "changed_file").alias("changed"), (F.col("kind") == "blast_radius").alias("blast"))
    status = F.when(F.col("event_type") == "error", "superseded").otherwise("accepted")
    decisions = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") / 100.0).alias("score"), status.alias("status"))
    return reports.handover(code, i.where("kind = 'memory'").select(F.col("ord").alias("id"), F.col("confidence").alias("score")), decisions)


@query(ITEMS + "SELECT ord, CASE WHEN ord % 2 = 1 THEN 'none' WHEN est_tokens > 2000 OR confidence >= 0.8 THEN 'high' WHEN est_tokens > 500 THEN 'medium' ELSE 'low' END AS risk FROM items")
def risk_labels(spark, d):
    return items(spark, d).select("ord", classify.risk(F.col("ord") % 2 == 0, F.col("est_tokens"), F.col("confidence")).alias("risk"))


@query(
    ITEMS + "SELECT repo, source, CASE WHEN coalesce(c1, 0) >= 0.75 AND coalesce(c1, 0) - coalesce(c2, 0) >= 0.15 THEN 'narrow' WHEN coalesce(c1, 0) >= 0.55 THEN 'standard' ELSE 'broad' END AS depth FROM "
    "(SELECT repo, source, max(CASE WHEN rk = 1 THEN confidence END) AS c1, max(CASE WHEN rk = 2 THEN confidence END) AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY repo, source ORDER BY confidence DESC, ord) AS rk FROM items) r GROUP BY repo, source) g"
)
def depth_label(spark, d):
    r = ranking.ranked(items(spark, d), ["repo", "source"])
    top = lambda k: F.max(F.when(F.col("rank") == k, F.col("confidence")))
    g = r.groupBy("repo", "source").agg(top(1).alias("c1"), top(2).alias("c2"))
    return g.select("repo", "source", classify.depth_label(F.col("c1"), F.col("c2")).alias("depth"))


@query(
    ITEMS + "SELECT ord, CASE WHEN ord % 3 = 0 THEN 'given' WHEN v IS NOT NULL AND ord % 7 > 0 AND title <> '' THEN v || ' `' || title || '` lines ' || (ord % 7) || '-' || (ord % 7 + 5) ELSE coalesce(r, 'Included in context pack') END AS reason FROM items "
    f"LEFT JOIN {values_sql(list(reports.REASONS.items()))} ON a = kind LEFT JOIN (SELECT a AS k2, b AS v FROM {values_sql(list(reports.SYMBOL_REASONS.items()))}) z ON k2 = kind".replace(" ON a = kind", " ON v.a = kind").replace("coalesce(r,", "coalesce(v.b,")
)
def reason_text(spark, d):
    given = F.when(F.col("ord") % 3 == 0, "given").otherwise("")
    by_symbol = reports.symbol_reason(F.col("kind"), F.col("title"), F.col("ord") % 7, F.col("ord") % 7 + 5)
    return items(spark, d).select("ord", reports.reason(F.coalesce(F.nullif(given, F.lit("")), by_symbol), F.col("kind")).alias("reason"))


DEDUP = (
    ITEMS + "SELECT ord, CAST(n - 1 AS BIGINT) AS duplicates_hidden FROM (SELECT ord, row_number() OVER (PARTITION BY repo, {k} ORDER BY confidence DESC, ord) AS rk, count(*) OVER (PARTITION BY repo, {k}) AS n FROM items) x WHERE rk = 1"
)
NORMAL = "lower(regexp_replace(trim(path), '^[./]+', ''))"


@query(DEDUP.format(k=f"title, {NORMAL}"))
def dedup_ranked(spark, d):
    return ranking.dedup_ranked(items(spark, d), ["repo"]).select("ord", "duplicates_hidden")


@query(DEDUP.format(k=f"{NORMAL}, string_split(title, '(')[1], excerpt"))
def dedup_stubs(spark, d):
    return ranking.dedup_stubs(items(spark, d), ["repo"]).select("ord", "duplicates_hidden")


@query(DEDUP.format(k=NORMAL))
def dedup_by_file(spark, d):
    return ranking.dedup_by_file(items(spark, d), ["repo"]).select("ord", "duplicates_hidden")


@query(
    ITEMS + "SELECT repo, ord FROM (SELECT *, max(confidence) OVER (PARTITION BY repo) AS top, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, ord) AS rk FROM items) x "
    "WHERE confidence >= greatest(0.55 * top, 0.30) - 1e-9 OR rk = 1"
)
def score_floor(spark, d):
    return ranking.score_floor(items(spark, d), ["repo"]).select("repo", "ord")




@query(
    "WITH RECURSIVE " + ITEMS[5:] + ", r AS (SELECT *, row_number() OVER (PARTITION BY repo, source ORDER BY confidence / greatest(1, est_tokens) DESC, confidence DESC, ord) AS i FROM items), "
    "f AS (SELECT repo, source, i, ord, (est_tokens <= 1500 OR kind = 'changed_file') AS take, CASE WHEN est_tokens <= 1500 OR kind = 'changed_file' THEN est_tokens ELSE 0 END AS used, CAST(0 AS BIGINT) AS before, (kind = 'changed_file') AS seen FROM r WHERE i = 1 "
    "UNION ALL SELECT r.repo, r.source, r.i, r.ord, (f.used + r.est_tokens <= 1500 OR (r.kind = 'changed_file' AND NOT f.seen)), CASE WHEN f.used + r.est_tokens <= 1500 OR (r.kind = 'changed_file' AND NOT f.seen) THEN f.used + r.est_tokens ELSE f.used END, CAST(f.used AS BIGINT), "
    "(f.seen OR r.kind = 'changed_file') FROM f JOIN r ON r.repo = f.repo AND r.source = f.source AND r.i = f.i + 1) "
    "SELECT repo, source, ord, before AS used_before FROM f WHERE take"
)
def budget_knapsack(spark, d):
    return ranking.knapsack(items(spark, d), ["repo", "source"], 1500, ["changed_file"])


@query(
    "WITH RECURSIVE " + ITEMS[5:] + ", r AS (SELECT *, row_number() OVER (PARTITION BY repo, source ORDER BY (kind <> 'memory'), confidence / greatest(1, est_tokens) DESC, confidence DESC, ord) AS i FROM items), "
    "f AS (SELECT repo, source, i, ord, kind, (est_tokens <= CASE WHEN kind = 'memory' THEN 600 ELSE 2000 END) AS take, CASE WHEN est_tokens <= CASE WHEN kind = 'memory' THEN 600 ELSE 2000 END THEN est_tokens ELSE 0 END AS used FROM r WHERE i = 1 "
    "UNION ALL SELECT r.repo, r.source, r.i, r.ord, r.kind, (f.used + r.est_tokens <= CASE WHEN r.kind = 'memory' THEN 600 ELSE 2000 END), CASE WHEN f.used + r.est_tokens <= CASE WHEN r.kind = 'memory' THEN 600 ELSE 2000 END THEN f.used + r.est_tokens ELSE f.used END "
    "FROM f JOIN r ON r.repo = f.repo AND r.source = f.source AND r.i = f.i + 1) "
    "SELECT repo, source, ord, CASE WHEN kind = 'memory' THEN 'memory' ELSE 'code' END AS part FROM f WHERE take"
)
def memory_sub_budget(spark, d):
    return ranking.sub_budget(items(spark, d), ["repo", "source"], 2000, 0.3, F.col("kind") == "memory").select("repo", "source", "ord", "part")


@query(
    ITEMS + "SELECT repo, source, ord FROM (SELECT *, min(CASE WHEN top > 0.4 AND confidence < 0.4 AND prev - confidence < 0.02 THEN rk END) OVER (PARTITION BY repo, source) AS cut FROM "
    "(SELECT *, row_number() OVER w AS rk, lag(confidence) OVER w AS prev, max(confidence) OVER (PARTITION BY repo, source) AS top FROM items WINDOW w AS (PARTITION BY repo, source ORDER BY confidence DESC, ord)) a) b "
    "WHERE confidence >= 0.6 * top AND (cut IS NULL OR rk < cut)"
)
def adaptive_topk(spark, d):
    return ranking.adaptive_top_k(items(spark, d), ["repo", "source"]).select("repo", "source", "ord")


@query(
    "WITH RECURSIVE " + ITEMS[5:] + ", r AS (SELECT *, row_number() OVER (PARTITION BY repo, source ORDER BY confidence DESC, ord) AS i FROM items), "
    "f AS (SELECT repo, source, i, ord, true AS keep, est_tokens AS used FROM r WHERE i = 1 "
    "UNION ALL SELECT r.repo, r.source, r.i, r.ord, NOT (f.used >= 2250 AND r.kind = 'file' AND r.confidence < 0.4), CASE WHEN f.used >= 2250 AND r.kind = 'file' AND r.confidence < 0.4 THEN f.used ELSE f.used + r.est_tokens END FROM f JOIN r ON r.repo = f.repo AND r.source = f.source AND r.i = f.i + 1) "
    "SELECT repo, source, ord FROM f WHERE keep"
)
def tail_cutoff(spark, d):
    return ranking.tail_cutoff(items(spark, d), ["repo", "source"], 3000)


@query(
    ITEMS + "SELECT repo, ord, CAST(rk AS INTEGER) AS rank, CAST(total AS BIGINT) AS total, total > 20 AS has_more FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, ord) AS rk, count(*) OVER (PARTITION BY repo) AS total FROM items) x WHERE rk > 10 AND rk <= 20"
)
def paginate(spark, d):
    return ranking.paginate(items(spark, d), ["repo"], 2, 10).select("repo", "ord", "rank", "total", "has_more")


@query(
    ITEMS + "SELECT repo, ord, CAST(slot AS INTEGER) AS slot FROM (SELECT repo, ord, row_number() OVER (PARTITION BY repo ORDER BY pin, confidence DESC, ord) - 1 AS slot FROM (SELECT *, CASE WHEN kind = 'impacted_test' AND row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN kind = 'impacted_test' THEN 0 ELSE 1 END, confidence DESC, ord) = 1 THEN 0 ELSE 1 END AS pin FROM items) a) b WHERE slot < 5"
)
def minimal_pack(spark, d):
    return ranking.pinned_minimal(items(spark, d), ["repo"], F.col("kind") == "impacted_test").select("repo", "ord", "slot")


@query(
    ITEMS + "SELECT repo, source, ord FROM (SELECT *, max(CASE WHEN kind = 'changed_file' THEN 1 ELSE 0 END) OVER (PARTITION BY repo, source) AS any_changed FROM items) x WHERE any_changed = 0 OR kind = 'changed_file'"
)
def source_discovery(spark, d):
    return ranking.discovery(items(spark, d), ["repo", "source"]).select("repo", "source", "ord")


@query(
    ITEMS + ", n AS (SELECT repo, path, count(*) AS n FROM items GROUP BY repo, path) SELECT repo, path, n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, path) AS k FROM n) x WHERE k <= 5"
)
def source_histogram(spark, d):
    return reports.histogram(items(spark, d), ["repo"], "path")


@query(
    ITEMS + "SELECT repo, CAST(sum(est_tokens) AS BIGINT) AS total, CAST(sum(CASE WHEN kind = 'memory' THEN est_tokens ELSE 0 END) AS BIGINT) AS memory_tokens, round(sum(CASE WHEN kind = 'memory' THEN est_tokens ELSE 0 END) / sum(est_tokens), 4) AS memory_ratio FROM items GROUP BY repo"
)
def budget_breakdown(spark, d):
    return reports.budget_breakdown(items(spark, d), ["repo"])


#: Three packs of each language: of all items, of documents as settings, and without tests.
SETTINGS = "CASE WHEN path LIKE 'docs/%' THEN replace(path, '.md', '.YAML') ELSE path END"


@query(
    ITEMS + f", p AS (SELECT repo || '-all' AS pack, {SETTINGS} AS path, confidence, ord FROM items UNION ALL SELECT repo || '-set', {SETTINGS}, confidence, ord FROM items WHERE path LIKE 'docs/%' OR ord % 10 = 3 UNION ALL SELECT repo || '-src', path, confidence, ord FROM items WHERE path NOT LIKE 'tests/%'), "
    "t AS (SELECT pack, path AS first FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY confidence DESC, ord) AS k FROM p) x WHERE k = 1), c AS (SELECT pack, count(*) FILTER (WHERE path LIKE '%.YAML') AS n, count(*) AS total FROM p GROUP BY pack) "
    "SELECT pack, CASE WHEN first LIKE 'tests/%' THEN 'debug' WHEN n >= greatest(2, total // 2) THEN 'review' ELSE 'implement' END AS next_tool FROM t JOIN c USING (pack)"
)
def next_tool(spark, d):
    i = items(spark, d).withColumn("set", F.expr(SETTINGS))
    parts = [i.selectExpr("repo || '-all' AS pack", "set AS path", "confidence", "ord"), i.where("path LIKE 'docs/%' OR ord % 10 = 3").selectExpr("repo || '-set' AS pack", "set AS path", "confidence", "ord")]
    every = parts[0].unionByName(parts[1]).unionByName(i.where("path NOT LIKE 'tests/%'").selectExpr("repo || '-src' AS pack", "path", "confidence", "ord"))
    return reports.next_tool(every, ["pack"])


@query(ITEMS + "SELECT ord, '[' || repo || '] ' || title AS title, round(least(0.95, confidence + CASE WHEN repo IN ('fr', 'de') THEN 0.10 ELSE 0 END + CASE WHEN repo = 'de' THEN 0.05 ELSE 0 END), 6) AS confidence FROM items")
def workspace_merge(spark, d):
    i = items(spark, d)
    linked, producers = i.where("repo in ('fr', 'de')").select("repo"), i.where("repo = 'de'").select("repo")
    out = workspace.merged(workspace.link_boosts(i, linked, producers))
    return out.select("ord", "title", F.round("confidence", 6).alias("confidence"))


@query("SELECT l_linenumber AS depth, round(0.45 * pow(0.7, l_linenumber - 1), 4) AS confidence, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def decay_chain(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("depth")).agg(F.count("*").alias("n"))
    return li.withColumn("confidence", scores.call_chain_confidence(F.col("depth"))).select("depth", "confidence", "n")


@query(ITEMS + "SELECT ord, printf('%s (%.2f) %s', path, confidence, CASE WHEN ord % 2 = 0 THEN title ELSE '' END) AS line FROM items")
def render_lines(spark, d):
    return items(spark, d).select("ord", sinks.compact_line(F.col("path"), F.when(F.col("ord") % 2 == 0, F.col("title")), F.col("confidence")).alias("line"))


@query(
    ITEMS + "SELECT i.ord FROM items i JOIN (SELECT DISTINCT repo, path FROM items WHERE kind = 'config') v ON i.repo = v.repo AND i.path = v.path"
)
def lookup_join(spark, d):
    i = items(spark, d)
    return reports.matching(i, i.where("kind = 'config'"), ["repo", "path"]).select("ord")


#: Files of documents, what they refer to, and the evidence of a failure: traces of
#: suppliers with other roots, one with and one without signals.
DEBUG = (
    "WITH s AS (SELECT doc_id AS node, " + PATH + " AS path FROM documents), e AS (SELECT doc_id AS src, doc_id + 4 AS dst FROM documents WHERE doc_id % 6 = 0), "
    "g AS (SELECT s_suppkey AS ord, 'm' || (s_suppkey % 6) AS message, '/abs/main_src' || (s_suppkey % 20) || '.py' AS p FROM supplier WHERE s_suppkey % 5 = 0), "
    "past AS (SELECT 'docs/fr.md' AS path UNION ALL SELECT 'old/main_src3.py'), ch AS (SELECT DISTINCT path FROM s WHERE path IN ('src/en_src1.py', 'src/de_src4.py', 'lib/src5.py')), "
    "n AS (SELECT DISTINCT path FROM (SELECT b.path FROM e JOIN s a ON e.src = a.node JOIN s b ON e.dst = b.node WHERE a.path IN (SELECT path FROM ch) UNION SELECT a.path FROM e JOIN s a ON e.src = a.node JOIN s b ON e.dst = b.node WHERE b.path IN (SELECT path FROM ch)) x WHERE path NOT IN (SELECT path FROM ch)), "
    "k AS (SELECT node, path, {some} AS told, CASE WHEN {some} AND string_split(path, '/')[-1] IN (SELECT string_split(p, '/')[-1] FROM g) THEN 'runtime_signal' WHEN path IN (SELECT path FROM past) OR string_split(path, '/')[-1] IN (SELECT string_split(path, '/')[-1] FROM past) THEN 'past_debug' "
    "WHEN path IN (SELECT path FROM ch) THEN 'changed_file' WHEN string_split(path, '/')[-1] LIKE 'test@_%' ESCAPE '@' AND ({some} OR replace(replace(string_split(path, '/')[-1], 'test_', ''), '.py', '') IN (SELECT replace(string_split(path, '/')[-1], '.py', '') FROM ch)) THEN 'failing_test' "
    "WHEN path IN (SELECT path FROM n) THEN 'blast_radius' ELSE 'file' END AS kind FROM s) "
    "SELECT told, node, kind, round(CASE kind WHEN 'runtime_signal' THEN 0.95 WHEN 'past_debug' THEN 0.90 WHEN 'changed_file' THEN least(0.95, 0.70 * 1.15) WHEN 'failing_test' THEN 0.85 WHEN 'blast_radius' THEN 0.50 ELSE 0.20 END, 6) AS confidence FROM k"
)


@query(f"SELECT * FROM ({DEBUG.format(some='true')}) a UNION ALL SELECT * FROM ({DEBUG.format(some='false')}) b")
def debug_symbols(spark, d):
    symbols = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.expr(PATH).alias("path"))
    edges = table(spark, d, "documents").where("doc_id % 6 = 0").selectExpr("doc_id AS src", "doc_id + 4 AS dst")
    signals = table(spark, d, "supplier").where("s_suppkey % 5 = 0").selectExpr("s_suppkey AS ord", "'m' || (s_suppkey % 6) AS message", "array('/abs/main_src' || (s_suppkey % 20) || '.py') AS paths", "array('a', 'b') AS stack")
    past = spark.createDataFrame([("docs/fr.md",), ("old/main_src3.py",)], "path string")
    changed = symbols.where(F.col("path").isin("src/en_src1.py", "src/de_src4.py", "lib/src5.py")).select("path")
    parts = [candidates.debug_symbols(symbols, edges, g, past, changed).select(F.lit(some).alias("told"), "node", "kind", "confidence") for some, g in ((True, signals), (False, signals.limit(0)))]
    return parts[0].unionByName(parts[1])


@query(
    "SELECT CASE WHEN user_id % 3 = 0 THEN 'runtime' ELSE 'f' || user_id || '.py' END AS path, substr(message, 1, 80) AS title, CASE WHEN user_id % 2 = 0 THEN message ELSE 'at a' || event_id || chr(10) || 'at b' END AS excerpt, 'runtime_signal' AS kind, 0.95::DOUBLE AS confidence FROM "
    "(SELECT *, row_number() OVER (PARTITION BY message ORDER BY event_id) AS k FROM (SELECT *, event_type || ' ' || props || repeat('x', 70) AS message FROM events) x) y WHERE k = 1"
)
def signal_items(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id AS ord", "event_type || ' ' || props || repeat('x', 70) AS message", "CASE WHEN user_id % 3 = 0 THEN array() ELSE array('f' || user_id || '.py') END AS paths",
        "CASE WHEN user_id % 2 = 0 THEN array() ELSE array('at a' || event_id, 'at b') END AS stack",
    )
    return candidates.signal_items(rows)
