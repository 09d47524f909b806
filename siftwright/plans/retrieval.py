"""Text retrieval and semantic scoring over documents, pages and embeddings."""

from __future__ import annotations



from pyspark.sql import functions as F

from siftwright.functions import scores
from siftwright.functions import text as tx
from siftwright.operators import embedding, graph, inverted, memory, retrieval, workspace
from siftwright.plans.registry import query, table, values, values_sql

QUERY = "that the whst thinor andeaner une queaux menteau"
WORDS = tx.query_tokens(QUERY)
TOKENS = (
    r"list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({c}, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), "
    r"'([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 3))"
)
BM25 = (
    "WITH t AS (SELECT doc_id, lang, source, n_chars, " + TOKENS.format(c="text") + " AS toks FROM documents), "
    "s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(avg(len(toks)) AS DOUBLE) AS mean FROM t), "
    "q AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in WORDS) + "]) AS w), "
    "d AS (SELECT w, count(*) FILTER (WHERE list_contains(toks, w)) AS n FROM t, q GROUP BY w), "
    "i AS (SELECT w, ln((s.n - d.n + 0.5) / (d.n + 0.5) + 1) AS idf FROM d, s), "
    "r AS (SELECT doc_id, lang, source, n_chars, sum(CASE WHEN list_contains(toks, w) THEN idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(toks) / mean)) ELSE 0 END) AS raw "
    "FROM t, i, s GROUP BY doc_id, lang, source, n_chars), "
    "b AS (SELECT doc_id, lang, source, n_chars, CASE WHEN (SELECT max(raw) FROM r) > 0 THEN raw / (SELECT max(raw) FROM r) ELSE 0 END AS bm25 FROM r) "
)
CONF = "round((doc_id * 37 % 100) / 100.0, 2)"


def scored(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.bm25(docs, QUERY, F.col("text"), keep=["doc_id"])


@query(BM25 + "SELECT doc_id, round(bm25, 6) AS score FROM b ORDER BY round(bm25, 6) DESC, doc_id LIMIT 20")
def bm25_top_docs(spark, d):
    out = scored(spark, d).select("doc_id", F.round("bm25", 6).alias("score"))
    return out.orderBy(F.desc("score"), "doc_id").limit(20)


@query(BM25 + f"SELECT doc_id, round(least(0.95, 0.6 * {CONF} + 0.4 * bm25), 6) AS confidence FROM b")
def bm25_blend(spark, d):
    return scored(spark, d).select("doc_id", F.round(retrieval.blend(F.expr(CONF), F.col("bm25")), 6).alias("confidence"))


PATH = "CASE doc_id % 5 WHEN 0 THEN 'src/main_' || source || '.py' WHEN 1 THEN 'tests/test_' || source || '.py' WHEN 2 THEN 'docs/' || lang || '.md' WHEN 3 THEN 'src/' || lang || '_' || source || '.py' ELSE './src/' || source || '.go' END"


@query(
    f"WITH p AS (SELECT doc_id, {CONF} AS c, {PATH} AS path FROM documents) SELECT doc_id, round(CASE WHEN "
    r"replace(replace(lower(regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '')), '-', '_'), '.', '_') IN ('src3', 'src7', 'read') "
    "AND path NOT LIKE 'tests/%' THEN least(0.95, c * 1.3) ELSE c END, 6) AS confidence FROM p"
)
def stem_boost(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.expr(CONF).cast("double").alias("c"), F.expr(PATH).alias("path"))
    return p.select("doc_id", F.round(retrieval.stem_boost(F.col("c"), F.col("path"), "src3 or src7, read"), 6).alias("confidence"))


@query(
    f"WITH p AS (SELECT doc_id, {CONF} AS c, {PATH} AS path FROM documents) SELECT doc_id, round(CASE WHEN regexp_extract(path, '[^/]*$') IN ('src4.go', 'fr.md') "
    "THEN least(0.95, c + 0.4) ELSE c END, 6) AS confidence FROM p"
)
def filename_boost(spark, d):
    p = table(spark, d, "documents").select("doc_id", F.expr(CONF).cast("double").alias("c"), F.expr(PATH).alias("path"))
    return p.select("doc_id", F.round(retrieval.filename_boost(F.col("c"), F.col("path"), "see src4.go and fr.md"), 6).alias("confidence"))


@query(
    "WITH t AS (SELECT p_partkey, " + TOKENS.format(c="p_name") + " AS toks FROM part), "
    "m AS (SELECT p_partkey, CAST((len(list_filter(toks, lambda x: starts_with(x, 'gre'))) > 0) AS INTEGER) + CAST((len(list_filter(toks, lambda x: starts_with(x, 'sma'))) > 0) AS INTEGER) "
    "+ CAST((len(list_filter(toks, lambda x: starts_with(x, 'blu'))) > 0) AS INTEGER) AS matched FROM t) "
    "SELECT p_partkey, matched FROM m WHERE matched > 0 ORDER BY matched DESC, p_partkey LIMIT 200"
)
def prefix_search(spark, d):
    return retrieval.prefix_search(table(spark, d, "part"), "gre sma blu", F.col("p_name"), ["p_partkey"]).select("p_partkey", "matched")


#: Terms of the query below as stems, and the stems of the parts' words that differ
#: from the words.
TERMS, STEMMED = ("larg", "economi", "bra", "wi", "1"), {"large": "larg", "economy": "economi"}


@query(
    "WITH w AS (SELECT p_partkey AS id, unnest(string_split(lower(p_name), ' ') || [lower(p_type)] || string_split(lower(p_brand), '#')) AS word FROM part), "
    "s AS (SELECT id, CASE word " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STEMMED.items()) + " ELSE word END AS word FROM w), "
    "l AS (SELECT id, count(*) AS length FROM s GROUP BY id), t AS (SELECT count(*) AS items, sum(length) AS words FROM l), "
    "h AS (SELECT id, term, count(*) AS n FROM s, (SELECT unnest([" + ", ".join(f"'{t}'" for t in TERMS) + "]) AS term) WHERE starts_with(word, term) GROUP BY id, term), "
    "d AS (SELECT term, greatest(1e-6, ln(((SELECT items FROM t) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM h GROUP BY term) "
    "SELECT id, round(sum(idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length * (SELECT items FROM t) / (SELECT words FROM t)))), 6) AS score FROM h JOIN d USING (term) JOIN l USING (id) GROUP BY id"
)
def inverted_index_search(spark, d):
    """All parts that the stored index finds for a stemmed prefix query."""
    path = graph.shared_path(spark, "index")
    inverted.build(table(spark, d, "part"), "p_partkey", ["p_name", "p_type", "p_brand"], path)
    return inverted.search(spark, path, "LARGES economies, bra* wi 1", None).select("id", F.round("score", 6).alias("score"))


AGE = "date_diff('second', ts, TIMESTAMP '2024-01-31') / 86400.0"


def as_of():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


@query(
    f"SELECT event_id, round(CASE WHEN value > 50 THEN 1 + (value / 100.0) / (1 + sqrt(greatest({AGE}, 0))) ELSE 1 / (1 + sqrt(greatest({AGE}, 0))) END, 6) AS score FROM events"
)
def recency_retrieval(spark, d):
    e = table(spark, d, "events")
    bm = F.when(F.col("value") > 50, F.col("value") / 100.0).otherwise(0.0)
    return retrieval.recency_retrieval(e, bm, scores.age_days(F.col("ts"), as_of())).select("event_id", F.round("score", 6).alias("score"))


COS = (
    "WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), "
    "c AS (SELECT vec_id, label, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product(CAST(qv AS DOUBLE[]), CAST(qv AS DOUBLE[]))) AS cos FROM embeddings, q) "
)


def similarities(spark, d):
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").first()["embedding"]
    q = F.array(*[F.lit(float(x)) for x in first])
    return e.withColumn("cos", scores.cosine(F.col("embedding"), q))


@query(COS + "SELECT vec_id, round(cos, 6) AS cos FROM c ORDER BY round(cos, 6) DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    return similarities(spark, d).select("vec_id", F.round("cos", 6).alias("cos")).orderBy(F.desc("cos"), "vec_id").limit(10)


@query(COS + "SELECT vec_id, round(least(0.95, 0.4 + label * 0.05 + least(0.15, greatest(0, cos - 0.3) * 0.3)), 6) AS confidence FROM c")
def semantic_boost(spark, d):
    return similarities(spark, d).select("vec_id", F.round(retrieval.semantic_boost(0.4 + F.col("label") * 0.05, F.col("cos")), 6).alias("confidence"))


@query(
    f"WITH p AS (SELECT doc_id, {CONF} AS c, {PATH} AS path, n_chars FROM documents ORDER BY {CONF} DESC, doc_id LIMIT 30) "
    "SELECT doc_id, round(greatest(0, least(0.95, (0.5 * c + 0.5 / (1 + exp(-(n_chars % 100 - 50) / 25.0))) * CASE WHEN path LIKE 'tests/%' THEN 0.85 ELSE 1.15 END)), 6) AS confidence FROM p"
)
def rerank_blend(spark, d):
    p = table(spark, d, "documents").select("doc_id", "n_chars", F.expr(CONF).cast("double").alias("c"), F.expr(PATH).alias("path"))
    out = retrieval.rerank(p, "c", lambda x: x.withColumn("rerank_score", (F.col("n_chars") % 100 - 50) / 25.0), F.col("path"), ["doc_id"])
    return out.select("doc_id", F.round("c", 6).alias("confidence"))


@query(f"WITH p AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT doc_id FROM p WHERE regexp_matches(path, '(^|[/_])src(1|7)\\.(py|go)$') AND doc_id % 3 < 2")
def query_widening(spark, d):
    """Widened where nothing, or documentation alone, has changed."""
    p = table(spark, d, "documents").select("doc_id", F.expr(PATH).alias("path"))
    changed = F.when(F.col("doc_id") % 3 == 1, F.array(F.lit("docs/a.py"), F.lit("README.md"))).when(F.col("doc_id") % 3 == 2, F.array(F.lit("README.md"), F.lit("src/a.py")))
    return retrieval.widened(p, "fix the main docs of src1 and src7", F.col("path"), changed).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tention') OR contains(lower(text), 'eaux') ORDER BY doc_id LIMIT 50")
def keyword_baseline(spark, d):
    return retrieval.keyword_baseline(table(spark, d, "documents"), "tention of eaux", F.col("text"), ["doc_id"]).select("doc_id")


@query("SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END + 40 AS BIGINT) AS est_tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text"), 40).alias("est_tokens"))


@query(
    "SELECT page_id, e AS endpoint FROM pages, (SELECT unnest(['/the', '/and', '/eaux']) AS e) WHERE regexp_matches(html, '[\"''`]' || e || '[\"''`?/)\\s]')"
)
def endpoint_refs(spark, d):
    return workspace.endpoint_refs(table(spark, d, "pages"), ["/the", "/and", "/eaux"], "page_id", "html")


CALLS = [
    ("await api.post('/x', body)", "POST"), ("fetch('/x', { method: 'PUT' })", "PUT"), ("client.get(u); client.delete( '/x')", "DELETE"), ("open('/x')", None),
    ("$http->patch('/x')", "PATCH"), ("http.request('HEAD', '/x')", "HEAD"), ("fetch('/x', {method:POST})", "POST"), ("x.options('/x', { method: 'PUT' })", "OPTIONS"),
    ("f('get', '/x', {method = 'delete'})", "DELETE"), ("a('/y')", None),
]


#: Calls made from events: a verb before the path as a call, after it as an option, or
#: bare before it; some have two, and some none.
VERB_OF = "CASE user_id % 4 WHEN 0 THEN 'post' WHEN 1 THEN 'Put' WHEN 2 THEN 'DELETE' ELSE 'head' END"
MADE_CALLS = (
    f"SELECT event_id, {VERB_OF} AS verb, CASE event_id % 5 WHEN 0 THEN 'api.' || {VERB_OF} || '(''/x'', ' || event_type || ')' WHEN 1 THEN 'fetch(''/x'', {{{{ method: ''' || {VERB_OF} || ''' }}}})' "
    f"WHEN 2 THEN 'send(\"' || {VERB_OF} || '\", ''/x'')' WHEN 3 THEN 'a->patch (''/x'', method=' || {VERB_OF} || ')' ELSE 'open(''/x'', ' || {VERB_OF} || ')' END AS call FROM {{t}}"
)
METHOD_SQL = "CASE event_id % 5 WHEN 3 THEN 'PATCH' WHEN 4 THEN NULL ELSE upper(verb) END"


@query(f"SELECT a AS call, b AS method FROM {values_sql(CALLS)} UNION ALL SELECT call, {METHOD_SQL} FROM ({MADE_CALLS.format(t='events')}) x")
def http_method_infer(spark, d):
    p = values(spark, CALLS).select(F.col("a").alias("call")).union(spark.sql(MADE_CALLS, t=table(spark, d, "events")).select("call"))
    return p.select("call", workspace.inferred_method(F.col("call"), F.instr("call", "'/x'"), F.lit(4)).alias("method"))


@query(
    f"SELECT a AS call, coalesce(b = 'POST', false) AS posts FROM {values_sql(CALLS)} UNION ALL SELECT call, coalesce({METHOD_SQL} = 'POST', false) FROM ({MADE_CALLS.format(t='events')}) x"
)
def endpoint_method_refs(spark, d):
    p = values(spark, CALLS).select(F.col("a").alias("call")).union(spark.sql(MADE_CALLS, t=table(spark, d, "events")).select("call"))
    return p.select("call", workspace.references_endpoint(F.col("call"), "/x", "post").alias("posts"))


ERRORS = [
    ("ValueError", "bad value at line 12"), ("ValueError", "bad value at line 99"), ("KeyError", "at 0x7Ffe12 port 8080 id 12"), ("E", "Line: 3, a1234b 567 x  y"),
    ("E", "line3 aline 4 AT LINE 5 99 100"), ("", ""),
]


@query(
    rf"SELECT a AS name, b AS message, substr(sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a || ': ' || b, '\b(at\s+)?line[:\s]+\d+', '', 'gi'), '0x[0-9a-fA-F]+', '', 'g'), '\b\d{{3,}}\b', '', 'g'), '\s+', ' ', 'g')))), 1, 16) AS error_hash FROM {values_sql(ERRORS)} "
    rf"UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), substr(sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(event_type || ': at line ' || user_id || ' in 0x1F' || event_id || ' code ' || props, '\b(at\s+)?line[:\s]+\d+', '', 'gi'), '0x[0-9a-fA-F]+', '', 'g'), '\b\d{{3,}}\b', '', 'g'), '\s+', ' ', 'g')))), 1, 16) FROM events"
)
def error_signature(spark, d):
    cases = values(spark, ERRORS).select(F.col("a").alias("name"), F.col("b").alias("message"), tx.error_hash(F.col("a"), F.col("b")).alias("error_hash"))
    message = F.concat(F.lit("at line "), F.col("user_id").cast("string"), F.lit(" in 0x1F"), F.col("event_id").cast("string"), F.lit(" code "), "props")
    rows = table(spark, d, "events").select(F.lit("events"), F.col("event_id").cast("string"), tx.error_hash(F.col("event_type"), message))
    return cases.union(rows)


TRACES = [
    ('  File "a/b.py", line 3, in f|    x()|  File "a/b.py", line 9|  File "c.py", line 1', "a/b.py,c.py"),
    ("at com.x.A.f(Foo.java:12)|at com.x.B.g(Bar.kt:3)|at x.y(Unknown Source)", "Foo.java,Bar.kt"),
    ("   at N.C.M(String s) in /src/My App/C.cs:line 42|plain a/b.c words", "/src/My App/C.cs"), ("nothing here", ""),
]


#: Traces made from parts: Python and Java frames in turn, one of them again, and a
#: .NET frame.
MADE_TRACES = (
    "SELECT p_partkey, '  File \"lib/' || p_brand || '.py\", line ' || p_size || ', in f|  at a.b.C(P' || (p_partkey % 9) || '.java:' || p_size || ')|noise p' || p_partkey || '.py|  File \"lib/' || p_brand || '.py\", line 1|   at N.M(Int32 x) in /s/' || p_name || '.cs:line 4' AS trace, "
    "'lib/' || p_brand || '.py,P' || (p_partkey % 9) || '.java,/s/' || p_name || '.cs' AS paths FROM {t}"
)


@query(f"SELECT a AS trace, b AS paths FROM {values_sql(TRACES)} UNION ALL SELECT trace, paths FROM ({MADE_TRACES.format(t='part')}) x")
def path_extract(spark, d):
    rows = values(spark, TRACES).select(F.col("a").alias("trace")).union(spark.sql(MADE_TRACES, t=table(spark, d, "part")).select("trace"))
    return rows.select("trace", F.array_join(tx.paths_in(F.split("trace", "[|]")), ",").alias("paths"))


SLUGS = [
    ("Use SQLite for local storage", "use-sqlite-for-local-storage", "use-sqlite-for-local-storage", "subsystem-use-sqlite-for-local-storage-7"),
    ("It's  a_test -- (v2)!", "its-a-test-v2", "its-atest-v2", "subsystem-it-s-a-test-v2-7"), ("Été à l'École", "été-à-lécole", "t-lcole", "subsystem-été-à-l-école-7"),
    ("", "", "", "subsystem-community-7"), ("a" * 50 + " b", "a" * 50 + "-b", "a" * 40, "subsystem-" + "a" * 50 + "-b-7"),
]


@query(
    f"SELECT a AS title, b AS slug, c AS file_slug, d AS anchor FROM {values_sql(SLUGS)} UNION ALL SELECT t, "
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), "
    r"regexp_replace(regexp_replace(regexp_replace(replace(substr(lower(t), 1, 40), ' ', '-'), '[^a-z0-9-]', '', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), "
    r"'subsystem-' || coalesce(nullif(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'community') || '-7' FROM (SELECT substr(text, 1, 90) AS t FROM documents) x"
)
def slugs(spark, d):
    rows = values(spark, SLUGS).select(F.col("a").alias("title")).union(table(spark, d, "documents").select(F.substring("text", 1, 90)))
    t = F.col("title")
    return rows.select("title", tx.slug(t).alias("slug"), tx.file_slug(t).alias("file_slug"), tx.anchor(t, F.lit(7)).alias("anchor"))


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 3), chr(10)) AS body FROM documents")
def body_slice(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.lines(F.col("text"), 2, 3).alias("body"))


@query(rf"SELECT doc_id, lower(regexp_replace(trim({PATH}), '^[./]+', '')) AS path FROM documents")
def path_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normal_path(F.expr(PATH)).alias("path"))


#: (path, is a test or script, is documentation, is a test file by its stem, tested stem)
PATHS = [
    ("tests/a.py", True, False, False, "a"), ("a/test/b.js", True, False, False, "b"), ("src\\tests\\a.cs", True, False, False, "src\\tests\\a"), ("Tests/a.py", False, False, False, "a"),
    ("src/test_a.py", True, False, True, "a"), ("src/a_test.go", True, False, True, "a"), ("src/ATest.java", True, False, False, "ATest"), ("src/a.spec.ts", True, False, False, "a.spec"),
    ("src/aSpec.ts", True, False, False, "aSpec"), ("SCRIPT/x.sh", True, False, False, "x"), ("example/x.py", True, False, False, "x"), ("latest/x.py", False, False, False, "x"),
    ("src/contest.py", True, False, False, "contest"), ("a/README", False, False, False, "README"), ("README", False, True, False, "README"), ("readme.txt", False, True, False, "readme"),
    ("src/license.py", False, False, False, "license"), ("doc/x.py", False, True, False, "x"), ("a/Documentation/b.txt", False, True, False, "b"), ("a/b.RST", False, True, False, "b"),
    ("notes.txt", False, False, False, "notes"), ("tests/test_readme.md", True, True, True, "readme"),
]


#: Paths made from parts: a folder, a beginning, the part and an ending.
MADE_PATHS = (
    "SELECT CASE p_size % 6 WHEN 0 THEN 'tests/' WHEN 1 THEN 'src/' WHEN 2 THEN '' WHEN 3 THEN 'a/Docs/' WHEN 4 THEN 'latest/' ELSE 'x/fixtures/' END || CASE p_partkey % 4 WHEN 0 THEN 'test_' WHEN 1 THEN 'README' ELSE 'p' END || p_partkey || "
    "CASE p_partkey % 5 WHEN 0 THEN '_test.go' WHEN 1 THEN '.md' WHEN 2 THEN 'Spec.ts' ELSE '.py' END AS p FROM {t}"
)


@query(
    f"SELECT a AS path, b AS is_test, c AS is_docs, d AS is_test_file, e AS tested_stem FROM {values_sql(PATHS)} UNION ALL "
    "SELECT p, p LIKE 'tests/%' OR p LIKE '%/fixtures/%' OR n LIKE 'test\\_%' ESCAPE '\\' OR n LIKE '%\\_test.go' ESCAPE '\\' OR n LIKE '%Spec.ts', n LIKE '%.md' OR p LIKE '%/Docs/%' OR (p = n AND n LIKE 'README%'), s LIKE 'test\\_%' ESCAPE '\\' OR s LIKE '%\\_test' ESCAPE '\\', "
    "CASE WHEN s LIKE 'test\\_%' ESCAPE '\\' THEN substr(s, 6) WHEN s LIKE '%\\_test' ESCAPE '\\' THEN left(s, length(s) - 5) ELSE s END "
    f"FROM (SELECT p, string_split(p, '/')[-1] AS n, string_split(string_split(p, '/')[-1], '.')[1] AS s FROM ({MADE_PATHS.format(t='part')}) x) y"
)
def path_predicates(spark, d):
    p = F.col("path")
    rows = values(spark, PATHS).select(F.col("a").alias("path")).union(spark.sql(MADE_PATHS, t=table(spark, d, "part")))
    return rows.select("path", tx.is_test_path(p).alias("is_test"), tx.is_docs_path(p).alias("is_docs"), tx.is_test_file(p).alias("is_test_file"), tx.tested_stem(p).alias("tested_stem"))


DIFFS = [("README.md|docs/a.py", True), ("README.md|src/a.py", False), ("CHANGELOG", True), ("", False)]


#: Changes made from the lines of an order: documents, and now and then code.
MADE_DIFFS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 45 THEN 'docs/p' || l_partkey || '.py' WHEN l_quantity < 48 THEN 'CHANGELOG' || l_partkey ELSE 'src/p' || l_partkey || '.py' END AS p FROM {t}"


@query(
    f"SELECT a AS paths, b AS docs_only FROM {values_sql(DIFFS)} UNION ALL SELECT string_agg(p, '|' ORDER BY l_linenumber, p), bool_and(p NOT LIKE 'src/%') FROM ({MADE_DIFFS.format(t='lineitem')}) x GROUP BY l_orderkey"
)
def docs_only_diff(spark, d):
    made = spark.sql(MADE_DIFFS, t=table(spark, d, "lineitem")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p"))).alias("s"))
    rows = values(spark, DIFFS).select(F.col("a").alias("paths")).union(made.select(F.array_join(F.col("s.p"), "|")))
    return rows.select("paths", tx.docs_only(F.filter(F.split("paths", "[|]"), lambda x: x != "")).alias("docs_only"))


ENTRIES = [
    ("main", True), ("Main", True), ("test", False), ("test_a", True), ("testA", True), ("testing", False), ("getOwner", True), ("get_owner", True), ("getter", False),
    ("get", False), ("postFoo", True), ("optionsX", True), ("Delete_x", True), ("mainly", False), ("", False), ("TestFoo", True),
]


#: Names made from parts: a verb or another word, a joint, and the part's first word.
MADE_NAMES = (
    "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'test' WHEN 1 THEN 'GET' WHEN 2 THEN 'patch' WHEN 3 THEN 'main' WHEN 4 THEN 'widget' ELSE 'TEST' END AS verb, CASE p_partkey % 4 WHEN 0 THEN '_' || p_type WHEN 1 THEN p_type WHEN 2 THEN '' ELSE lower(p_type) END AS rest FROM {t}"
)


@query(
    f"SELECT a AS name, b AS is_entry FROM {values_sql(ENTRIES)} UNION ALL SELECT verb || rest, CASE lower(verb) WHEN 'main' THEN rest = '' WHEN 'widget' THEN false ELSE p_partkey % 4 < 2 END FROM ({MADE_NAMES.format(t='part')}) x"
)
def entry_names(spark, d):
    rows = values(spark, ENTRIES).select(F.col("a").alias("name")).union(spark.sql(MADE_NAMES, t=table(spark, d, "part")).selectExpr("verb || rest"))
    return rows.select("name", tx.is_entry_name(F.col("name")).alias("is_entry"))


SECRETS = [
    ("TOKEN=abc,def;ghi next", "TOKEN=[REDACTED] next"), ("api_key: super secret", "api_key:[REDACTED] secret"), ("Authorization: Bearer eyJ.a-b_c~d+e/f==", "Authorization: Bearer [REDACTED]"),
    ("bearer abc", "bearer abc"), ("Password = x y", "Password =[REDACTED] y"), ("tokens are fun", "tokens are fun"),
]


@query(
    rf"SELECT a AS text, b AS redacted FROM {values_sql(SECRETS)} UNION ALL "
    r"SELECT CAST(doc_id AS VARCHAR), regexp_replace(regexp_replace(t, '((?:password|passwd|secret|token|api[_-]?key)\s*)([=:])\s*\S+', '\1\2[REDACTED]', 'gi'), 'Bearer\s+[A-Za-z0-9\-._~+/]+=*', 'Bearer [REDACTED]', 'g') "
    "FROM (SELECT doc_id, text || ' Token: abc' || doc_id || ', Bearer x.y' || doc_id AS t FROM documents) x"
)
def redact(spark, d):
    cases = values(spark, SECRETS).select(F.col("a").alias("text"), tx.redact(F.col("a")).alias("redacted"))
    t = F.concat("text", F.lit(" Token: abc"), F.col("doc_id").cast("string"), F.lit(", Bearer x.y"), F.col("doc_id").cast("string"))
    return cases.union(table(spark, d, "documents").select(F.col("doc_id").cast("string"), tx.redact(t)))


@query(
    "WITH n AS (SELECT event_id, event_type, props, substr(sha256(event_type || ':' || substr(props, 1, 80)), 1, 16) AS h, user_id % 4 AS n_files FROM events), "
    "k AS (SELECT DISTINCT substr(sha256(event_type || ':' || substr(props, 1, 80)), 1, 16) AS h FROM events WHERE value > 99) "
    "SELECT min(event_id) AS event_id, h AS task_hash FROM n WHERE n_files >= 1 AND h NOT IN (SELECT h FROM k) GROUP BY h"
)
def capture_dedup(spark, d):
    e = table(spark, d, "events")
    known = e.where("value > 99").select(tx.short_hash(F.concat_ws(":", "event_type", F.substring("props", 1, 80))).alias("task_hash"))
    out = memory.capture(e, known, F.col("event_type"), F.col("props"), F.col("user_id") % 4, ["event_id"])
    return out.select("event_id", "task_hash")


@query(
    "WITH t AS (SELECT p_partkey AS id, p_name || ' ' || p_brand || '(' || p_type || ')' AS text FROM part), w AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM t), "
    "b AS (SELECT id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 32 AS INTEGER) AS place, sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2) "
    "SELECT id, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM b WHERE v <> 0"
)
def embedding_vectors(spark, d):
    """Stored vectors of all parts: half of them encoded by a first update, the
    others by a second; the places that aren't zero."""
    store = embedding.VectorStore(spark, graph.shared_path(spark, "vectors"), embedding.HashingEncoder(32))
    parts = table(spark, d, "part").selectExpr("p_partkey AS id", "p_name", "p_brand || '(' || p_type || ')' AS signature", "CAST(NULL AS STRING) AS doc")
    text = embedding.embedding_text(F.col("p_name"), F.col("signature"), F.col("doc"))
    store.update(parts.where("id % 2 = 0"), text)
    store.update(parts, text)
    found = store.attach(parts, text).select("id", F.posexplode("embedding").alias("place", "value")).where("value <> 0")
    return found.select("id", "place", F.round("value", 6).alias("value"))
