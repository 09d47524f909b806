"""Text sources as rows, on texts made from the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwright.operators import sinks
from siftwright.sources import analyzers, code, contracts, parsers
from siftwright.plans.registry import query, table, values, values_sql


@query(
    "SELECT l_returnflag AS k, CASE l_linestatus WHEN 'O' THEN 'modified' ELSE 'renamed' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2"
)
def diff_name_status(spark, d):
    t = F.expr("concat(CASE l_linestatus WHEN 'O' THEN 'M' ELSE 'R100' END, '\\t', l_returnflag, '\\tnew', chr(10))")
    rows = parsers.name_status(table(spark, d, "lineitem").select(t.alias("text")), "text")
    return rows.groupBy(F.col("path").alias("k"), "status").agg(F.count("*").alias("n"))


@query(
    "SELECT p_partkey, 'src/' || p_brand || '.py' AS path, CAST(p_size + unnest(range(0, greatest(1, p_partkey % 4))) AS INTEGER) AS line FROM part"
)
def diff_hunks(spark, d):
    t = F.expr("concat('--- a/x', chr(10), '+++ b/src/', p_brand, '.py', chr(10), '@@ -1,2 +', p_size, ',', p_partkey % 4, ' @@ f', chr(10), '+x', chr(10))")
    return parsers.unified_diff(table(spark, d, "part").select("p_partkey", t.alias("text")), "p_partkey", "text")


LOG = [("12:00 warn: an error came", "warning"), ("Fatal WARN", "error"), ("severe", "error"), ("Warning x", "warning"), ("CRITICAL", "error"), ("errors and warned", None), ("info", None)]


@query(
    f"SELECT b AS severity, a AS message FROM {values_sql(LOG)} WHERE b IS NOT NULL UNION ALL "
    "SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END, event_id || CASE WHEN event_type = 'error' THEN ' ERROR x' ELSE ' Warning y' END FROM events WHERE event_type = 'error' OR user_id % 3 = 0"
)
def log_signals(spark, d):
    t = F.expr("concat('start', chr(10), event_id, CASE WHEN event_type = 'error' THEN ' ERROR x' WHEN user_id % 3 = 0 THEN ' Warning y' ELSE ' INFO z' END, chr(10), 'end')")
    return parsers.log_lines(values(spark, LOG).select(F.col("a").alias("text")).union(table(spark, d, "events").select(t)), "text")


@query("SELECT p_partkey, 'lib/' || p_brand || '.py' AS file, CAST(p_size AS INTEGER) AS line, 'f' || (p_partkey % 7) AS fn FROM part")
def trace_frames(spark, d):
    t = F.expr("concat('Traceback:', chr(10), '  File \"lib/', p_brand, '.py\", line ', p_size, ', in f', p_partkey % 7, chr(10), '    x()')")
    rows = parsers.stack_frames(table(spark, d, "part").select("p_partkey", t.alias("text")), "p_partkey", "text")
    first = F.get("frames", 0)
    return rows.select("p_partkey", first["file"].alias("file"), first["line"].alias("line"), first["function"].alias("fn"))


@query("SELECT doc_id, lang AS task, text AS body FROM documents")
def note_frontmatter(spark, d):
    t = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\ntask: "), F.col("lang"), F.lit("\n---\n"), F.col("text"))
    rows = parsers.frontmatter(table(spark, d, "documents").select("doc_id", t.alias("t")), "t", ["task"])
    return rows.select("doc_id", "task", "body")


@query("SELECT p_brand AS repo, '/v1/' || p_partkey AS path, 'GET' AS method, 'op' || p_partkey AS operation_id FROM part")
def openapi_endpoints(spark, d):
    t = F.expr("concat('{\"paths\": {\"/v1/', p_partkey, '\": {\"get\": {\"operationId\": \"op', p_partkey, '\"}, \"x-note\": {}}}}')")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("repo"), t.alias("t"))
    return parsers.openapi_endpoints(rows, "repo", "t")


@query("SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1))), '|') AS links, len(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS n_links FROM pages")
def page_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(links)), "|").alias("links"), F.size(links).cast("long").alias("n_links"))


@query("SELECT 'f' || (p_partkey % 50) || '.sql' AS path, 'table' AS kind, count(*) AS n FROM part GROUP BY 1")
def sql_symbols(spark, d):
    files = table(spark, d, "part").selectExpr("concat('f', p_partkey % 50, '.sql') AS path", "concat('CREATE TABLE t', p_partkey, ' (a INT);', chr(10), '-- x') AS text")
    return code.analyze(files).groupBy("path", "kind").agg(F.count("*").alias("n"))


@query("SELECT 'f' || p_partkey || '.py' AS path, 'f' || p_partkey AS src, 'g' || (p_partkey % 9) AS dst, 'calls' AS edge_type FROM part")
def python_edges(spark, d):
    files = table(spark, d, "part").selectExpr("concat('f', p_partkey, '.py') AS path", "concat('def f', p_partkey, '(a):', chr(10), '    return g', p_partkey % 9, '(a)', chr(10)) AS text")
    return code.analyze(files, "edges")


@query(r"""SELECT p_partkey, 'n' || p_partkey || '.py' AS path, CAST(p_size || '-' || (p_size + 3) AS VARCHAR) AS lines FROM part""")
def agent_pack(spark, d):
    reason = F.format_string("defines `x` lines %d-%d", "p_size", F.col("p_size") + 3)
    rows = table(spark, d, "part").select("p_partkey", sinks.agent_json(F.expr("concat('n', p_partkey, '.py')"), reason).alias("j"))
    return rows.select("p_partkey", F.get_json_object("j", "$.path").alias("path"), F.get_json_object("j", "$.lines").alias("lines"))


NOTES = [("x" * 60, 1, "debug", True), ("  " + "x" * 59 + "\n", 1, "debug", False), ("x" * 80, 0, "debug", False), ("x" * 80, 2, "scratch", False), ("x" * 80, 2, "scratchy", True), (None, 1, "debug", False), ("x" * 60, 1, None, True)]


@query(
    f"SELECT a AS summary, b AS n_files, c AS task_type, d AS kept FROM {values_sql(NOTES)} UNION ALL "
    "SELECT event_type || repeat('x', user_id % 80), user_id % 4, event_type, length(event_type || repeat('x', user_id % 80)) >= 60 AND user_id % 4 > 0 FROM events"
)
def note_gate(spark, d):
    cases = values(spark, NOTES).toDF("summary", "n_files", "task_type", "want").drop("want")
    rows = cases.union(table(spark, d, "events").selectExpr("concat(event_type, repeat('x', CAST(user_id % 80 AS INT)))", "user_id % 4", "event_type"))
    files = F.array_repeat(F.lit("f"), F.col("n_files").cast("int"))
    return rows.withColumn("kept", sinks.note_gate(F.col("summary"), files, F.col("task_type")))


#: A file in each language, for a part k of n = p_size body lines: its lines (None
#: stands for the body), and its symbols (kind, name, first line, last line less
#: n (a text: as it is; None: the first line), owner, has the comment) and edges (source, target, type).
FILES = {
    "java": (
        ["package x;", "import a.b.Lib{k};", "", "/** Part {k}; not a }} brace. */", "public class P{k} extends Base{m} implements Runs {{", '  String s = "}} {{ \\" }}";', "  // }}", "  @Test public int run{k}(List<Map<A, B>> a) {{", None, "    return new Q(a).help{m}(a);", "  }}", "}}"],
        [("class", "P{k}", 5, 11, None, True), ("method", "run{k}", 8, 10, "P{k}", False)],
        [("{f}", "Lib{k}", "imports"), ("P{k}", "Base{m}", "extends"), ("P{k}", "Runs", "implements"), ("run{k}", "help{m}", "calls")],
    ),
    "go": (
        ["package x", 'import "a/Lib{k}"', "", "// Part {k}; not a }} brace.", "type P{k} struct {{", "  s string // }}", "}}", "func (p *P{k}) run{k}(a map[string]int) int {{", None, "  x := `}}` + string('}}')", "  return help{m}(a)", "}}"],
        [("struct", "P{k}", 5, "7", None, True), ("method", "run{k}", 8, 11, "P{k}", False)],
        [("{f}", "a/Lib{k}", "imports"), ("run{k}", "string", "calls"), ("run{k}", "help{m}", "calls")],
    ),
    "rs": (
        ["use a::b::{{Lib{k}, Other as Own}};", "", "", "/// Part {k}; not a }} brace.", "struct P{k}<'a> {{ s: &'a str }}", "impl<'a> Runs for P{k}<'a> {{", "  // }}", "  fn run{k}(&self, a: i32) -> i32 {{", None, "    let c = '}}'; let r = r#\"}}\"}}\"#;", "    help{m}(a) }}", "}}"],
        [("struct", "P{k}", 5, None, None, True), ("method", "run{k}", 8, 10, "P{k}", False)],
        [("{f}", "Lib{k}", "imports"), ("{f}", "Own", "imports"), ("P{k}", "Runs", "implements"), ("run{k}", "help{m}", "calls")],
    ),
    "cs": (
        ["using A.B.Lib{k};", "namespace N", "{{", "/// Part {k}; not a }} brace.", "public class P{k} : Base{m}, IRuns {{", '  string s = @"}} "" {{";', "  public int Size => 3;", "  public async Task<int> run{k}(int a) {{", None, "    return await help{m}(a);", "  }}", "}} }}"],
        [("namespace", "N", 2, 11, None, False), ("class", "P{k}", 5, 11, None, True), ("property", "Size", 7, None, "P{k}", False), ("method", "run{k}", 8, 10, "P{k}", False)],
        [("{f}", "Lib{k}", "imports"), ("P{k}", "Base{m}", "extends"), ("P{k}", "IRuns", "implements"), ("run{k}", "help{m}", "calls")],
    ),
    "ts": (
        ["import {{ x }} from './Lib{k}'", "const q = `}} ${{1}}`", "", "/** Part {k}; not a }} brace. */", "export class P{k} extends Base{m}<T> implements Runs {{", "  private s = /[}}]/g", "  // }}", "  async run{k}(a: number): Promise<number> {{", None, "    return help{m}(a)", "  }}", "}}"],
        [("class", "P{k}", 5, 11, None, True), ("function", "run{k}", 8, 10, "P{k}", False)],
        [("{f}", "./Lib{k}", "imports"), ("P{k}", "Base{m}", "extends"), ("P{k}", "Runs", "implements"), ("run{k}", "help{m}", "calls")],
    ),
}


def _filled(template: str) -> str:
    """A template of k (the part) and m (its size modulo 7) as an SQL expression."""
    return "'" + template.replace("'", "''").format(k="' || p_partkey || '", m="' || (p_size % 7) || '") + "'"


def _files(spark, d):
    """The files of all parts."""
    cases = []
    for i, (extension, (lines, _, _)) in enumerate(FILES.items()):
        body = "repeat('    a += 1; // {' || chr(10), p_size)"
        text = " || ".join(body if x is None else _filled(x).replace("\\", "\\\\") + " || chr(10)" for x in lines)
        cases.append(f"WHEN {i} THEN struct(p_partkey || '.{extension}' AS path, {text} AS text)")
    rows = table(spark, d, "part").withColumns({"p_partkey": F.col("p_partkey").cast("string"), "p_size": F.col("p_size").cast("int")})
    return rows.select(F.expr(f"CASE p_partkey % {len(FILES)} {' '.join(cases)} END").alias("file")).select("file.*")


def _symbols_sql() -> str:
    parts = []
    for i, (extension, (_, symbols, _)) in enumerate(FILES.items()):
        for kind, name, first, last, owner, doc in symbols:
            end = f"{last} + p_size" if isinstance(last, int) else last or str(first)
            comment = _filled("Part {k}; not a }} brace.") if doc else "''"
            parts.append(
                f"SELECT p_partkey || '.{extension}' AS path, '{kind}' AS kind, {_filled(name)} AS name, CAST({first} AS BIGINT) AS line_start, CAST({end} AS BIGINT) AS line_end, "
                f"{_filled(owner) if owner else 'CAST(NULL AS VARCHAR)'} AS owner, {comment} AS docstring FROM part WHERE p_partkey % {len(FILES)} = {i}"
            )
    return " UNION ALL ".join(parts)


def _edges_sql() -> str:
    parts = []
    for i, (extension, (_, _, edges)) in enumerate(FILES.items()):
        for src, dst, kind in edges:
            source = f"p_partkey || '.{extension}'" if src == "{f}" else _filled(src)
            parts.append(f"SELECT p_partkey || '.{extension}' AS path, {source} AS src, {_filled(dst)} AS dst, '{kind}' AS edge_type FROM part WHERE p_partkey % {len(FILES)} = {i}")
    return " UNION ALL ".join(parts)


@query(_symbols_sql())
def code_symbols(spark, d):
    return code.analyze(_files(spark, d)).select("path", "kind", "name", "line_start", "line_end", "owner", "docstring")


@query(_edges_sql())
def code_edges(spark, d):
    return code.analyze(_files(spark, d), "edges")


class Failing:
    """A plug-in that doesn't read every seventh part."""

    def rows(self, path, text):
        if int(path.split(".")[0]) % 7 == 0:
            raise ValueError("no " + path)
        return [("file", path, 1, text.count("\n") + 1, "", None, "")], []


@query(
    "SELECT p_partkey || '.rb' AS path, 'rb' AS extension, 'ValueError: no ' || p_partkey || '.rb' AS error, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS line_end FROM part WHERE p_partkey % 7 = 0 "
    "UNION ALL SELECT p_partkey || '.rb', 'rb', NULL, 'file', 1 + p_size FROM part WHERE p_partkey % 7 <> 0"
)
def analyzer_registry(spark, d):
    """The first registration of an extension stays; files that fail are rows."""
    registry = analyzers.Registry()
    registry.register("rb", Failing)
    registry.register("rb", lambda: code.PatternFiles("rb"))
    registry.register("zz", dict)
    files = table(spark, d, "part").selectExpr("p_partkey || '.rb' AS path", "repeat('class X' || chr(10), p_size) AS text")
    indexed = analyzers.index(files, registry)
    good = analyzers.parts(indexed, "symbols").selectExpr("path", "'rb' AS extension", "CAST(NULL AS STRING) AS error", "kind", "line_end")
    return analyzers.parts(indexed, "errors").selectExpr("path", "extension", "error", "CAST(NULL AS STRING) AS kind", "CAST(NULL AS BIGINT) AS line_end").unionByName(good)


RUN = "concat('Failed N.C.T', event_id, chr(10), '  Error Message:', chr(10), '   boom ', event_id % 9, chr(10), '  Stack Trace:', chr(10), '     at N.C.T() in /p/F', event_id % 5, '.cs:line 4')"
MIXED = (
    "concat('Traceback:', chr(10), '  File \"lib/f', event_id % 5, '.py\", line 3, in g', chr(10), 'ValueError: bad ', event_id % 4, chr(10), chr(10), "
    "'ERROR in x', event_id % 3, '.py', chr(10), 'fine', chr(10), 'warn: ', event_id)"
)


@query(
    "WITH u AS (SELECT event_id, user_id, user_id % 3 AS kind, event_type FROM events), "
    "x AS (SELECT 'junit:' AS source, 'error' AS severity, 'k' || user_id || '.t' || event_id || ': ' || event_type AS message, user_id, CAST(NULL AS VARCHAR) AS file, 't' || event_id AS test FROM u WHERE kind = 0 "
    "UNION ALL SELECT 'dotnet', 'error', 'N.C.T' || event_id || ': boom ' || (event_id % 9), user_id, '/p/F' || (event_id % 5) || '.cs', NULL FROM u WHERE kind = 1 "
    "UNION ALL SELECT 'log', 'warning', 'warn: ' || event_id, user_id, NULL, NULL FROM u WHERE kind = 2 "
    "UNION ALL SELECT DISTINCT 'log', 'error', 'ERROR in x' || (event_id % 3) || '.py', user_id, 'x' || (event_id % 3) || '.py', NULL FROM u WHERE kind = 2 "
    "UNION ALL SELECT 'java', 'error', 'ValueError: bad ' || (event_id % 4), user_id, 'lib/f' || (min_by(event_id, event_id) % 5) || '.py', NULL FROM u WHERE kind = 2 GROUP BY user_id, event_id % 4) "
    "SELECT user_id, source, severity, message, file, test FROM x"
)
def runtime_signals(spark, d):
    """Reports, runner output and traces written from events, a file a user, read
    back by the data source."""
    from siftwright.operators.graph import shared_path
    from siftwright.sources import runtime

    spark.dataSource.register(runtime.RuntimeSource)
    place = shared_path(spark, "runtime")
    events = table(spark, d, "events").withColumn("kind", F.col("user_id") % 3)
    cases = events.where("kind = 0").selectExpr("user_id", "concat('k', user_id) AS _classname", "concat('t', event_id) AS _name", "named_struct('_message', event_type, '_VALUE', 'x') AS failure")
    # Files are small and many: they are dealt out by number, not by bytes, and each task commits its own.
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    commit = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
    cases.repartition(spread, "user_id").write.options(**commit).partitionBy("user_id").format("xml").option("rootTag", "testsuite").option("rowTag", "testcase").option("declaration", "").save(f"{place}/reports")
    texts = events.where("kind > 0").selectExpr("user_id", "event_id", f"CASE kind WHEN 1 THEN {RUN} ELSE {MIXED} END || chr(10) AS value")
    texts.repartition(spread, "user_id").sortWithinPartitions("user_id", "event_id").select("user_id", "value").write.options(**commit).partitionBy("user_id").text(f"{place}/texts")
    found = spark.read.format("runtime_signals").load(place)
    user = F.regexp_extract("path", r"user_id=(\d+)", 1).cast("long")
    test = F.regexp_extract(F.get("failing_tests", 0), r"\.(t\d+)$", 1)
    return found.select(user.alias("user_id"), "source", "severity", "message", F.get("paths", 0).alias("file"), test.alias("test"))


RECORDS = (
    "SELECT o_orderkey, 'Decide ' || o_orderpriority || ' #' || o_orderkey AS title, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'P' THEN 'superseded' ELSE 'proposed' END AS status, o_orderdate AS created_at, "
    "CASE o_orderkey % 2 WHEN 0 THEN '0.5' ELSE '0.9' END AS confidence, CASE o_custkey % 3 WHEN 0 THEN '' ELSE 'why ' || o_custkey END AS context, 'so ' || o_orderkey AS decision, CASE o_custkey % 4 WHEN 0 THEN NULL ELSE 'then' END AS consequences, "
    "CASE o_custkey % 5 WHEN 0 THEN NULL ELSE 'd' || o_custkey END AS superseded_by, o_custkey % 3 AS n_tags FROM {t}"
)


@query(
    "WITH r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, o_orderkey) AS number FROM (" + RECORDS.format(t="orders") + ") x WHERE status IN ('accepted', 'superseded')) "
    "SELECT format('{:04d}-{}.md', number, replace(replace(replace(lower(title), '#', ''), ' ', '-'), '--', '-')) AS file_name, '# ' || title || chr(10) || chr(10) || '**Status:** ' || status || '  **Date:** ' || strftime(created_at, '%Y-%m-%d') || '  **Confidence:** ' || confidence || chr(10) || "
    "CASE WHEN superseded_by IS NULL THEN '' ELSE chr(10) || '> **Superseded by:** `' || superseded_by || '`' || chr(10) END || chr(10) || CASE WHEN context = '' THEN '' ELSE '## Context' || chr(10) || chr(10) || context || chr(10) || chr(10) END || "
    "'## Decision' || chr(10) || chr(10) || decision || chr(10) || chr(10) || CASE WHEN consequences IS NULL THEN '' ELSE '## Consequences' || chr(10) || chr(10) || consequences || chr(10) || chr(10) END || "
    "'## Tags' || chr(10) || chr(10) || CASE n_tags WHEN 0 THEN '_none_' WHEN 1 THEN '`a`' ELSE '`a`, `b`' END || chr(10) AS content FROM r"
)
def decision_records(spark, d):
    """Records of decisions by status, newest first, numbered without a task that
    sees all."""
    rows = spark.sql(RECORDS, t=table(spark, d, "orders")).withColumn("tags", F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.col("n_tags").cast("int")))
    return sinks.decision_records(rows, [F.desc("created_at"), F.asc("o_orderkey")], ("accepted", "superseded"))


#: A file a part: OpenAPI in YAML or JSON, Protocol Buffers, GraphQL, or one that is
#: passed over by its name or folder.
CONTRACT_FILES = (
    "SELECT p_partkey AS k, p_brand AS repo, CASE p_partkey % 7 WHEN 0 THEN 'a/openapi' || p_partkey || '.yaml' WHEN 1 THEN 'my-API' || p_partkey || '.json' WHEN 2 THEN 'x/s.proto' WHEN 3 THEN 'q.gql' WHEN 4 THEN 'node_modules/api.yaml' WHEN 5 THEN 'plain.yaml' ELSE 'build/s.proto' END AS path, "
    "CASE p_partkey % 7 WHEN 1 THEN '{{\"openapi\": \"3\", \"paths\": {{\"/v1/' || p_partkey || '\": {{\"get\": {{\"operationId\": \"op' || p_partkey || '\"}}, \"x-a\": {{}}}}}}}}' "
    "WHEN 2 THEN 'service S' || p_partkey || ' {{' || chr(10) || '  rpc Run(Req' || p_size || ') returns (stream Res);' || chr(10) || '}}' WHEN 6 THEN 'service S {{ rpc Run(A) returns (B); }}' "
    "WHEN 3 THEN 'type Query {{' || chr(10) || '  part' || p_partkey || '(id: ID!): Part!' || chr(10) || '}}' "
    "ELSE 'openapi: 3.0.0' || chr(10) || 'paths:' || chr(10) || '  /v2/' || p_partkey || '/{{id}}:' || chr(10) || '    post:' || chr(10) || '      operationId: do' || p_partkey || chr(10) || '      requestBody:' || chr(10) || '        content:' || chr(10) || '    parameters:' || chr(10) END AS text FROM {t}"
)


@query(
    "SELECT p_brand AS repo, CASE p_partkey % 7 WHEN 2 THEN 'proto' WHEN 3 THEN 'graphql' ELSE 'openapi' END AS kind, "
    "CASE p_partkey % 7 WHEN 0 THEN 'POST /v2/' || p_partkey || '/{id}' WHEN 1 THEN 'GET /v1/' || p_partkey WHEN 2 THEN 'S' || p_partkey || '/Run' ELSE 'query part' || p_partkey END AS name, "
    "CASE p_partkey % 7 WHEN 0 THEN 'do' || p_partkey WHEN 1 THEN 'op' || p_partkey WHEN 2 THEN 'Req' || p_size || ' -> Res' ELSE 'Part!' END AS detail FROM part WHERE p_partkey % 7 < 4"
)
def contract_files(spark, d):
    return contracts.contracts(spark.sql(CONTRACT_FILES, t=table(spark, d, "part")))


@query(
    "SELECT 'd' || p_size || '/' || CASE p_partkey % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'skip' ELSE 'go' END AS folder, count(*) AS n FROM part WHERE p_partkey % 4 IN (0, 2, 3) AND p_size NOT IN (7, 17, 27, 37, 47) GROUP BY 1"
)
def scanned_files(spark, d):
    """Lines of the files below a folder, without ignored folders and suffixes."""
    from siftwright.operators.graph import shared_path

    place = shared_path(spark, "scan")
    parts = table(spark, d, "part").selectExpr("concat('d', p_size) AS a", "CASE p_partkey % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'skip' ELSE 'go' END AS b", "CAST(p_partkey AS STRING) AS value")
    parts.repartition("a", "b").write.partitionBy("a", "b").text(place)
    found = parsers.scan_files(spark, place, ["txt"], ["b=sk?p", "a=d*7", "_*"])
    folder = F.concat_ws("/", F.regexp_extract("path", "a=(d[0-9]+)", 1), F.regexp_extract("path", "b=([a-z]+)", 1))
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("long")
    return found.select(folder.alias("folder"), lines.alias("n")).groupBy("folder").agg(F.sum("n").alias("n"))


#: Queries with ids that repeat, without text and without gold.
ASKED = (
    "SELECT 'q' || CASE p_partkey % 11 WHEN 0 THEN 0 ELSE p_partkey END AS id, CASE p_partkey % 7 WHEN 0 THEN NULL ELSE p_name END AS q, CASE p_partkey % 5 WHEN 0 THEN NULL ELSE p_brand END AS gold FROM {t}"
)


@query(
    "WITH a AS (" + ASKED.format(t="part") + ") SELECT id, q, CASE WHEN q IS NULL THEN 'missing field' WHEN gold IS NULL THEN 'empty gold' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate id' END AS problem FROM a"
)
def jsonl_queries(spark, d):
    """Queries written as JSON lines and read back with what is wrong with each."""
    from siftwright.operators.graph import shared_path

    place = shared_path(spark, "queries")
    rows = spark.sql(ASKED, t=table(spark, d, "part")).select("id", "q", F.when(F.col("gold").isNotNull(), F.array("gold")).otherwise(F.array().cast("array<string>")).alias("gold"))
    rows.write.json(place)
    return parsers.queries_jsonl(spark, place).select("id", "q", "problem")


@query("SELECT event_id, event_type AS summary, 1::BIGINT AS n_files FROM events UNION ALL SELECT event_id + 1000000, 'again', 0 FROM events WHERE user_id % 3 = 0")
def session_notes(spark, d):
    """Notes of session texts, an object or a list of two each."""
    one = "concat('{\"event_id\": ', event_id, ', \"summary\": \"', event_type, '\", \"files\": [\"x\"]}')"
    two = "concat(', {\"event_id\": ', event_id + 1000000, ', \"summary\": \"again\", \"files\": []}]')"
    texts = table(spark, d, "events").selectExpr(f"CASE WHEN user_id % 3 = 0 THEN concat(' [', {one}, {two}) ELSE {one} END AS t")
    found = parsers.session_notes(texts, "t", "event_id:bigint,summary:string,files:array<string>")
    return found.select("event_id", "summary", F.size("files").cast("long").alias("n_files"))


@query(
    "SELECT 'k' || (user_id % 9) || '.t' || event_id AS test, CASE WHEN event_type = 'error' THEN 'error' ELSE 'failure' END AS kind, event_type AS message FROM events WHERE user_id % 3 < 2 UNION ALL SELECT 'k' || (user_id % 9) || '.t' || event_id, 'failure', 'body ' || event_id FROM events WHERE user_id % 3 = 2 AND event_id % 2 = 0"
)
def junit_cases(spark, d):
    """Reports written from events, some with messages, some with texts, some passed."""
    from siftwright.operators.graph import shared_path

    place = shared_path(spark, "reports")
    told = "named_struct('_message', event_type, '_VALUE', 'x')"
    rows = table(spark, d, "events").selectExpr(
        "concat('k', user_id % 9) AS _classname", "concat('t', event_id) AS _name",
        f"CASE WHEN user_id % 3 < 2 AND event_type <> 'error' THEN {told} WHEN user_id % 3 = 2 AND event_id % 2 = 0 THEN named_struct('_message', CAST(NULL AS STRING), '_VALUE', concat('body ', event_id)) END AS failure",
        f"CASE WHEN user_id % 3 < 2 AND event_type = 'error' THEN {told} END AS error",
    )
    rows.repartition(3).write.format("xml").option("rootTag", "testsuite").option("rowTag", "testcase").option("declaration", "").save(place)
    return parsers.junit_failures(spark, place)


@query("SELECT 'N.T' || event_id AS test, 'boom ' || (event_id % 9) AS message FROM events UNION ALL SELECT 'N.U' || event_id, '' FROM events WHERE user_id % 2 = 0")
def dotnet_cases(spark, d):
    t = "concat('Passed A', chr(10), 'Failed N.T', event_id, chr(10), '  Error Message:', chr(10), '   boom ', event_id % 9, chr(10), CASE WHEN user_id % 2 = 0 THEN concat('  Failed N.U', event_id, ' [1 ms]', chr(10)) ELSE '' END, 'Failed!')"
    return parsers.dotnet_failures(table(spark, d, "events").selectExpr(f"{t} AS t"), "t")


@query("SELECT o_orderstatus AS status, o_orderkey FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def bulk_insert(spark, d):
    """Two appends to one table, the second with some rows again."""
    from siftwright.operators.graph import shared_path

    place, rows = shared_path(spark, "bulk"), table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey")
    for k in (2, 1):
        sinks.append(rows.where(F.col("o_orderkey") % 3 < 2 if k == 2 else F.col("o_orderkey") % 3 == 1), place, ["status"])
    return spark.read.parquet(place).select("status", "o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#1' ORDER BY p_partkey LIMIT 10000")
def symbols_of_repo(spark, d):
    return sinks.capped_scan(table(spark, d, "part"), F.col("p_brand") == "Brand#1", "p_partkey").select("p_partkey", "p_name")


@query("SELECT ord, CASE category WHEN 'changed_file' THEN 0.5 WHEN 'blast_radius' THEN 0.70 WHEN 'impacted_test' THEN 0.60 WHEN 'config' THEN 0.9 WHEN 'query_match' THEN 0.55 ELSE 0.20 END::DOUBLE AS weight FROM (SELECT p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN 'changed_file' WHEN 1 THEN 'blast_radius' WHEN 2 THEN 'impacted_test' WHEN 3 THEN 'config' WHEN 4 THEN 'query_match' ELSE 'file' END AS category FROM part) x")
def weight_overrides(spark, d):
    """Weights of categories, two of them overridden."""
    from siftwright.operators import classify

    names = F.array(*[F.lit(x) for x in ("changed_file", "blast_radius", "impacted_test", "config", "query_match", "file")])
    category = F.get(names, (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), classify.weight_of(category, classify.REVIEW, {"changed_file": 0.5, "config": 0.9}).cast("double").alias("weight"))


@query(
    "WITH l AS (SELECT src, dst, max(c) AS c FROM (SELECT 'r' || (l_suppkey % 9) AS src, 'r' || (l_partkey % 9) AS dst, l_discount AS c FROM lineitem) x GROUP BY src, dst), k AS (SELECT * FROM l WHERE src <> 'r3' AND dst <> 'r3') "
    "SELECT src AS src_repo, dst AS dst_repo, CAST(c AS DOUBLE) AS confidence FROM k WHERE src <> 'r5' UNION ALL SELECT 'r5', 'r' || (p_size % 9), 0.5 FROM part WHERE p_size % 9 <> 3 GROUP BY 1, 2"
)
def repository_links(spark, d):
    """Links of repositories: the surest of equal ones, one repository removed, and
    all links of another replaced."""
    from siftwright.operators import registry

    found = table(spark, d, "lineitem").selectExpr("'r' || (l_suppkey % 9) AS src_repo", "'r' || (l_partkey % 9) AS dst_repo", "'imports' AS edge_kind", "l_discount AS confidence")
    links = registry.link(found.limit(0), found)
    repos = links.select(F.col("src_repo").alias("name")).distinct().withColumns({"path": F.lit("p"), "language": F.lit("x")})
    repos = registry.add_repo(repos, repos.where("name = 'r1'").withColumn("path", F.lit("q")))
    _, links = registry.remove_repo(repos, links, "r3")
    fresh = table(spark, d, "part").where("p_size % 9 <> 3").selectExpr("'r5' AS src_repo", "'r' || (p_size % 9) AS dst_repo", "'imports' AS edge_kind", "CAST(0.5 AS DOUBLE) AS confidence").distinct()
    return registry.refresh_source(links, "r5", fresh).select("src_repo", "dst_repo", "confidence")
