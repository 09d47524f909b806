"""Packs by mode with all signals, over candidates made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.functions import text as tx
from siftwright.operators import boosts, packs, ranking
from siftwright.plans.registry import QUERIES, SQL, table
from siftwright.plans.retrieval import TOKENS

QUERY = "that the whst thinor main src3 in src7 and main_src4_4.py eaux"
NAMED = ("main_src4_4.py",)
#: Candidates made from documents; changed files in two languages only.
ITEMS = (
    "SELECT doc_id AS ord, doc_id AS node, lang AS repo, CASE doc_id % 5 WHEN 0 THEN 'src/main_' || source || '_' || (doc_id % 9) || '.py' WHEN 1 THEN 'tests/test_' || source || '_' || (doc_id % 7) || '.py' "
    "WHEN 2 THEN 'docs/' || source || '_' || (doc_id % 6) || '.md' WHEN 3 THEN 'src/' || source || '.py' ELSE './src/' || source || '_' || (doc_id % 8) || '.go' END AS path, "
    "substr(text, 1, 4) || '(' || (doc_id % 3) || ')' AS title, substr(text, 1, 60) AS excerpt, CASE WHEN doc_id % 8 = 0 AND lang IN ('en', 'fr') THEN 'changed_file' WHEN doc_id % 8 < 2 THEN 'entrypoint' WHEN doc_id % 8 = 2 THEN 'contract' "
    "WHEN doc_id % 8 = 3 THEN 'memory' WHEN doc_id % 8 = 4 THEN 'impacted_test' WHEN doc_id % 8 = 5 THEN 'failing_test' WHEN doc_id % 8 = 6 THEN 'decision' ELSE 'file' END AS kind, "
    "CAST(round((doc_id * 37 % 100) / 100.0, 2) AS DOUBLE) AS confidence, CAST(20 + n_chars % 90 AS BIGINT) AS est_tokens, CAST(doc_id % 50 + 1 AS BIGINT) AS line_start, CAST(doc_id % 50 + 1 + doc_id % 4 AS BIGINT) AS line_end FROM {t}"
)
#: Evidence: deltas, hubs and bridges, changed lines, and consumers of a contract.
DELTAS = "SELECT DISTINCT path, CASE WHEN contains(path, 'src3') THEN CAST(0.05 AS DOUBLE) ELSE CAST(-0.1 AS DOUBLE) END AS delta FROM {t} WHERE contains(path, 'src3') OR contains(path, 'src8')"
CHANGED = "SELECT DISTINCT path, CAST(20 AS BIGINT) AS line FROM {t} WHERE contains(path, 'main')"
ENDPOINT, CONSUMER = "/v1/x", "src5"


def evidence(spark, items):
    """The evidence of ``packs.whole_pack`` for the candidates."""
    text = F.when(F.contains("path", F.lit(CONSUMER)), f"get('{ENDPOINT}')").otherwise("none")
    return packs.Evidence(
        deltas=spark.sql(DELTAS, t=items), hubs=items.select("node", (F.col("node") % 10 / 10.0).alias("hub")), bridges=items.select("node", (F.col("node") % 7 / 10.0).alias("bridge")),
        changed=spark.sql(CHANGED, t=items), files=items.select("path", text.alias("text")).dropDuplicates(["path"]), endpoints=[ENDPOINT],
    )


def whole_query(mode: str):
    def run(spark, d):
        items = spark.sql(ITEMS, t=table(spark, d, "documents"))
        out = packs.whole_pack(items, QUERY, mode, ["repo"], evidence(spark, items))
        return out.select("repo", "ord", "confidence", F.col("rank").cast("long").alias("rank"), "total_tokens")

    return run


def whole_sql(mode: str, source: str | None = None, budget: int | None = None, plain: bool = False) -> str:
    """The pack of ``source``; a plain one has no evidence and no last steps."""
    source = source or ITEMS.format(t="documents")
    words = tx.query_tokens(QUERY)
    share, least = ranking.FLOORS[mode]
    budget, sure = budget or packs.BUDGETS[mode], packs.GUARANTEED[mode]
    looks = packs.discovers(mode, packs.Evidence()) and not plain
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs) or "NULL"
    test, top = "starts_with(path, 'tests/')", "ORDER BY confidence DESC, ord"
    by_repo = "PARTITION BY repo"
    cap = int(budget * packs.MEMORY_SHARE)
    penalty = "confidence" if mode == "debug" and not looks else (
        f"CASE WHEN {test} AND kind NOT IN ({listed(boosts.EVIDENCE)}) AND coalesce(max(CASE WHEN NOT {test} THEN confidence END) OVER ({by_repo}), 0) >= {boosts.RIVAL} * confidence "
        f"THEN confidence * {boosts.DISCOVERY_PENALTY if looks else boosts.PENALTY} ELSE confidence END"
    )
    structure = "least(0.1, 0.07 * ((ord % 10) / 10.0) + 0.05 * ((ord % 7) / 10.0))"
    last = "confidence" if plain else f"CASE WHEN {structure} > 0 THEN least(0.95, confidence + {structure}) ELSE confidence END" if mode == "handover" else (
        "CASE WHEN contains(path, 'main') AND line_start <= 20 AND line_end >= 20 THEN least(0.95, confidence + 0.15) ELSE confidence END" if mode == "review" else "confidence"
    )

    def tail(source: str) -> str:
        if mode not in ("review", "implement") and not looks:
            return f"SELECT * FROM {source}"
        return (
            f"SELECT * EXCLUDE (k, prev, best, cut) FROM (SELECT *, min(CASE WHEN best > 0.4 AND confidence < 0.4 AND prev - confidence < 0.02 THEN k END) OVER ({by_repo}) AS cut FROM "
            f"(SELECT *, row_number() OVER ({by_repo} {top}) AS k, lag(confidence) OVER ({by_repo} {top}) AS prev, max(confidence) OVER ({by_repo}) AS best FROM {source}) x) y WHERE is_only OR (confidence >= 0.6 * best AND (cut IS NULL OR k < cut))"
        )

    def gained(source: str) -> str:
        if plain:
            return source
        return f"SELECT * REPLACE (round(CASE WHEN contains(path, '{CONSUMER}') THEN least(0.95, confidence + 0.1) ELSE confidence END, 6) AS confidence) FROM ({source})"

    sql = (
        f"WITH RECURSIVE it AS ({source}), "
        + ("fn AS (SELECT * FROM it), " if plain else f"fb AS (SELECT it.* REPLACE (CASE WHEN delta IS NULL THEN confidence ELSE greatest(0, least(0.95, confidence + delta)) END AS confidence) FROM it LEFT JOIN ({DELTAS.format(t='it')}) dl ON dl.path = it.path), "
        f"fn AS (SELECT * REPLACE (CASE WHEN lower(string_split(path, '/')[-1]) IN ({listed(NAMED)}) THEN least(0.95, confidence + 0.4) ELSE confidence END AS confidence) FROM fb), ")
        +         "co AS (SELECT ord AS o, string_split(path, '/')[-1] || ' ' || title || ' ' || excerpt AS corpus FROM it), tk AS (SELECT o, " + TOKENS.format(c="corpus") + " AS toks FROM co), "
        "st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(avg(len(toks)) AS DOUBLE) AS mean FROM tk), q AS (SELECT unnest([" + listed(words) + "]) AS w), "
        "df AS (SELECT w, count(*) FILTER (WHERE list_contains(toks, w)) AS n FROM tk, q GROUP BY w), idf AS (SELECT w, ln((st.n - df.n + 0.5) / (df.n + 0.5) + 1) AS idf FROM df, st), "
        "rw AS (SELECT o, sum(CASE WHEN list_contains(toks, w) THEN idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(toks) / mean)) ELSE 0 END) AS raw FROM tk, idf, st GROUP BY o), "
        "bm AS (SELECT o, CASE WHEN (SELECT max(raw) FROM rw) > 0 THEN raw / (SELECT max(raw) FROM rw) ELSE 0 END AS bm25 FROM rw), "
        "bl AS (SELECT fn.* REPLACE (least(0.95, 0.6 * confidence + 0.4 * bm25) AS confidence) FROM fn JOIN bm ON o = ord), "
        f"pe AS (SELECT * REPLACE ({penalty} AS confidence) FROM bl), "
        r"sm AS (SELECT * REPLACE (CASE WHEN replace(replace(lower(regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '')), '-', '_'), '.', '_') IN (" + listed(words) + f") AND NOT {test} THEN least(0.95, confidence * 1.3) ELSE confidence END AS confidence) FROM pe), "
        f"sc AS (SELECT * REPLACE (round({last}, 6) AS confidence), lower(regexp_replace(trim(path), '^[./]+', '')) AS plain FROM sm), "
        f"d1 AS (SELECT * FROM (SELECT *, row_number() OVER ({by_repo}, plain, string_split(title, '(')[1], excerpt {top}) AS k1 FROM sc) x WHERE k1 = 1), "
        f"d2 AS (SELECT * FROM (SELECT *, row_number() OVER ({by_repo}, plain {top}) AS k2 FROM d1) x WHERE k2 = 1), "
        f"on1 AS (SELECT *, {'max(CASE WHEN kind = ' + repr('changed_file') + f' THEN 1 ELSE 0 END) OVER ({by_repo}) = 1' if looks else 'false'} AS is_only FROM d2), "
        "on2 AS (SELECT *, is_only OR kind IN ('memory', 'decision') AS free FROM on1 WHERE NOT is_only OR kind = 'changed_file'), "
        f"fl AS (SELECT *, max(confidence) OVER (PARTITION BY repo, free) AS top, row_number() OVER (PARTITION BY repo, free {top}) AS k3 FROM on2), "
        f"po AS (SELECT * EXCLUDE (k1, k2, k3, top) FROM fl WHERE free OR confidence >= greatest({share} * top, {least}) - 1e-9 OR k3 = 1), "
        f"rr AS (SELECT repo, ord, kind IN ('memory', 'decision') AS mem, coalesce(kind IN ({listed(sure)}), false) AS g, est_tokens AS t, row_number() OVER ({by_repo} ORDER BY kind IN ('memory', 'decision') DESC, confidence / greatest(1, est_tokens) DESC, confidence DESC, ord) AS i FROM po), "
        f"f AS (SELECT repo, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ord, false AS take, CAST(0 AS BIGINT) AS um, CAST(0 AS BIGINT) AS uc, false AS sm, false AS sc FROM (SELECT DISTINCT repo FROM po) z UNION ALL SELECT n.repo, n.i, n.ord, n.take, "
        "n.um + CASE WHEN n.take AND n.mem THEN n.t ELSE 0 END, n.uc + CASE WHEN n.take AND NOT n.mem THEN n.t ELSE 0 END, n.sm OR (n.take AND n.mem AND n.g), n.sc OR (n.take AND NOT n.mem AND n.g) FROM "
        f"(SELECT r.repo, r.i, r.ord, r.mem, r.g, r.t, f.um, f.uc, f.sm, f.sc, CASE WHEN r.mem THEN f.um + r.t <= {cap} OR (r.g AND NOT f.sm) ELSE f.uc + r.t <= greatest(0, {budget} - f.um) OR (r.g AND NOT f.sc) END AS take FROM f JOIN rr r ON r.repo = f.repo AND r.i = f.i + 1) n), "
        "s1 AS (SELECT po.* FROM po JOIN f ON po.repo = f.repo AND po.ord = f.ord AND f.take AND f.i > 0), "
    )
    if looks:
        sql += (
            f"pn AS (SELECT * FROM (SELECT *, row_number() OVER ({by_repo} {top}) AS k4 FROM po WHERE kind NOT IN ({listed(boosts.OVERLAYS)}) AND NOT {test}) x WHERE k4 = 1 AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.repo = x.repo AND s1.path = x.path)), "
            f"pr AS (SELECT *, row_number() OVER ({by_repo} ORDER BY pin DESC, confidence DESC, ord) AS i FROM (SELECT repo, ord, confidence, est_tokens AS t, true AS pin FROM pn UNION ALL SELECT repo, ord, confidence, est_tokens, false FROM s1) x), "
            "hp AS (SELECT DISTINCT repo FROM pn), "
            "g AS (SELECT repo, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ord, false AS take, CAST(0 AS BIGINT) AS u FROM (SELECT DISTINCT repo FROM pr) z UNION ALL SELECT n.repo, n.i, n.ord, n.take, n.u + CASE WHEN n.take THEN n.t ELSE 0 END FROM "
            f"(SELECT r.repo, r.i, r.ord, r.t, g.u, r.pin OR r.repo NOT IN (SELECT repo FROM hp) OR g.u + r.t <= {budget} AS take FROM g JOIN pr r ON r.repo = g.repo AND r.i = g.i + 1) n), "
            "s2 AS (SELECT po.* FROM po JOIN g ON po.repo = g.repo AND po.ord = g.ord AND g.take AND g.i > 0), "
        )
    else:
        sql += "s2 AS (SELECT * FROM s1), "
    sql += f"s3 AS ({tail('s2')}), s4 AS ({gained('SELECT * FROM s3')}), "
    if mode == "review" and not plain:
        sql += (
            f"tr AS (SELECT repo, ord, kind, confidence, est_tokens AS t, row_number() OVER ({by_repo} {top}) AS i FROM s4), "
            "h AS (SELECT repo, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS ord, false AS take, CAST(0 AS BIGINT) AS u FROM (SELECT DISTINCT repo FROM tr) z UNION ALL SELECT n.repo, n.i, n.ord, n.take, n.u + CASE WHEN n.take THEN n.t ELSE 0 END FROM "
            f"(SELECT r.repo, r.i, r.ord, r.t, h.u, NOT (h.u >= {0.75 * budget} AND r.kind = 'file' AND r.confidence < 0.4) AS take FROM h JOIN tr r ON r.repo = h.repo AND r.i = h.i + 1) n), "
            "s5 AS (SELECT s4.* FROM s4 JOIN h ON s4.repo = h.repo AND s4.ord = h.ord AND h.take AND h.i > 0), "
        )
    else:
        sql += "s5 AS (SELECT * FROM s4), "
    if mode == "minimal" and not plain:
        sql += (
            f"wide AS ({gained(tail('po'))}), bc AS (SELECT * FROM (SELECT *, row_number() OVER ({by_repo} {top}) AS k5 FROM wide WHERE kind IN ({listed(boosts.CODE_KINDS)})) x WHERE k5 = 1), "
            f"pg AS (SELECT * FROM (SELECT *, row_number() OVER ({by_repo} {top}) AS k6 FROM s5) x WHERE k6 <= {packs.MINIMAL_ITEMS}), "
            "un AS (SELECT repo, ord, confidence, est_tokens, 0 AS p FROM bc UNION ALL SELECT repo, ord, confidence, est_tokens, k6 FROM pg WHERE NOT EXISTS (SELECT 1 FROM bc WHERE bc.repo = pg.repo AND bc.path = pg.path AND bc.title = pg.title)), "
            f"fin AS (SELECT *, row_number() OVER ({by_repo} ORDER BY p) AS rank FROM un) SELECT repo, ord, confidence, rank, CAST(sum(est_tokens) OVER ({by_repo}) AS BIGINT) AS total_tokens FROM fin WHERE rank <= {packs.MINIMAL_ITEMS}"
        )
    else:
        sql += f"fin AS (SELECT *, row_number() OVER ({by_repo} {top}) AS rank FROM s5) SELECT repo, ord, confidence, rank, CAST(sum(est_tokens) OVER ({by_repo}) AS BIGINT) AS total_tokens FROM fin"
    return sql


for _mode in packs.BUDGETS:
    QUERIES[f"whole_pack_{_mode}"] = whole_query(_mode)
    SQL[f"whole_pack_{_mode}"] = whole_sql(_mode)


LINKED, PRODUCERS = ("fr", "de"), ("de",)


def workspace_query(spark, d):
    """One pack over all languages as repositories."""
    items = spark.sql(ITEMS, t=table(spark, d, "documents"))
    linked, producers = (items.where(F.col("repo").isin(*x)).select("repo") for x in (LINKED, PRODUCERS))
    out = packs.workspace_pack(items, QUERY, "review", linked, producers, evidence(spark, items), budget=2000)
    return out.withColumn("rank", F.col("rank").cast("long"))


def workspace_sql() -> str:
    one = ITEMS.format(t="documents")
    gain = "(CASE WHEN i.repo IN ('fr', 'de') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN i.repo = 'de' THEN 0.05::DOUBLE ELSE 0 END)"
    second = f"SELECT i.* REPLACE ('all' AS repo, '[' || i.repo || '] ' || i.title AS title, least(0.95, f.confidence + {gain}) AS confidence) FROM ({one}) i JOIN ({whole_sql('review')}) f ON f.ord = i.ord"
    return (
        f"SELECT i.repo, s.ord, '[' || i.repo || '] ' || i.title AS title, s.confidence, s.rank, s.total_tokens, b.baseline, round(100.0 * (b.baseline - s.total_tokens) / b.baseline, 1) AS reduction "
        f"FROM ({whole_sql('review', second, 2000, True)}) s JOIN ({one}) i ON i.ord = s.ord, (SELECT CAST(sum(est_tokens) AS BIGINT) AS baseline FROM ({one}) z) b"
    )


QUERIES["full_pack_workspace"], SQL["full_pack_workspace"] = workspace_query, workspace_sql()
