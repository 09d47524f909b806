from pyspark.sql import functions as F

from siftwright import catalog
from siftwright.functions import scores
from siftwright.functions import text as tx
from siftwright.operators import evaluation, graph, memory, packs, ranking, retrieval
from siftwright.sources import code, parsers
from tests.compare import assert_same


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokens_are_distinct_lower_and_long_enough(spark):
    assert one(spark, tx.tokens(F.lit("HTTPServer parseJSON parse_json a bc"))) == ["http", "server", "parse", "json"]
    assert one(spark, tx.tokens(F.lit(None).cast("string"))) == []


def test_token_estimate(spark):
    assert [one(spark, tx.token_estimate(F.lit(t))) for t in ("", "abc", "a" * 17)] == [0, 1, 4]


def test_bm25_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id long, t string")
    assert retrieval.bm25(empty, "some query", F.col("t")).count() == 0


def test_knapsack_guarantee_can_exceed_the_budget(spark):
    rows = [("g", 1, 0.9, 100, "file"), ("g", 2, 0.8, 500, "changed_file"), ("g", 3, 0.5, 10, "file")]
    df = spark.createDataFrame(rows, "grp string, ord long, confidence double, est_tokens long, kind string")
    got = ranking.knapsack(df, ["grp"], 120, ["changed_file"]).collect()
    assert {r["ord"] for r in got} == {1, 2, 3}
    assert {r["ord"] for r in ranking.knapsack(df, ["grp"], 105).collect()} == {3} | set()


def test_floor_keeps_the_best_row(spark):
    df = spark.createDataFrame([("g", 1, 0.1), ("g", 2, 0.05)], "grp string, ord long, confidence double")
    assert [r["ord"] for r in ranking.score_floor(df, ["grp"]).collect()] == [1]


def test_decay_and_access_steps(spark):
    assert one(spark, scores.decay(F.lit(0.0))) == 1.0
    assert abs(one(spark, scores.decay(F.lit(30.0))) - 0.5) < 1e-12
    assert [round(one(spark, scores.access_boost(F.lit(c))), 2) for c in (0, 4, 5, 25)] == [0.0, 0.0, 0.05, 0.2]


def test_cosine_of_zero_and_mismatched_vectors(spark):
    assert one(spark, scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, scores.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0


def test_feedback_needs_three_reports(spark):
    rows = [(["a"], [], []), (["a"], ["b"], []), (["a"], ["b"], [])]
    fb = spark.createDataFrame(rows, "missing array<string>, noisy array<string>, files_read array<string>")
    assert {r["path"]: round(r["delta"], 6) for r in memory.feedback_deltas(fb).collect()} == {"a": 0.05}


def test_components_of_hub_cycle_and_isolated_node(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 8)], "node long")
    got = {r["node"]: (r["component"], r["community"]) for r in graph.components(edges, nodes).collect()}
    assert got == {1: (1, 0), 2: (1, 0), 3: (1, 0), 5: (5, 1), 6: (5, 1), 8: (8, 2)}


def test_bfs_depths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in graph.bfs(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_precision_and_recall_of_empty_sets(spark):
    none = F.array().cast("array<string>")
    assert one(spark, evaluation.precision(none, none)) == 1.0
    assert one(spark, evaluation.recall(F.array(F.lit("a")), none)) == 0.0


def test_unified_diff_lines(spark):
    text = "--- a/x\n+++ b/p.py\n@@ -1,2 +3,2 @@\n x\n@@ -9 +12,0 @@\n-y\n--- a/q\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    got = parsers.unified_diff(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()
    assert sorted((r["path"], r["line"]) for r in got) == [("p.py", 3), ("p.py", 4), ("p.py", 12)]


def test_stack_frames_of_three_languages(spark):
    text = 'File "a/b.py", line 3, in f\n  at com.x.Y.run(Y.java:41)\n  at N.C.M() in src/C.cs:line 7\n'
    frames = parsers.stack_frames(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").first()["frames"]
    assert [(f["file"], f["line"]) for f in frames] == [("a/b.py", 3), ("Y.java", 41), ("src/C.cs", 7)]


def test_contract_sources(spark):
    proto = "service S { rpc A (stream Q) returns (R); rpc B (Q) returns (stream R) {} }"
    got = parsers.proto_rpcs(spark.createDataFrame([("r", proto)], "repo string, t string"), "repo", "t").collect()
    assert [(r["rpc"], r["request_stream"], r["response_stream"]) for r in got] == [("A", True, False), ("B", False, True)]
    sdl = "type Query {\n  user(id: ID!): User!\n  all: [User] # x\n}\n"
    got = parsers.graphql_operations(spark.createDataFrame([("r", sdl)], "repo string, t string"), "repo", "t").collect()
    assert sorted((r["name"], r["return_type"]) for r in got) == [("all", "[User]"), ("user", "User!")]


def test_junit_and_notes(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<testsuites><testsuite><testcase classname="c" name="ok"/><testcase classname="c" name="bad"><failure message="boom">x</failure></testcase></testsuite></testsuites>')
    got = parsers.junit_failures(spark, str(tmp_path / "r.xml")).collect()
    assert [(r["test"], r["kind"], r["message"]) for r in got] == [("c.bad", "failure", "boom")]
    notes = parsers.session_notes(spark.createDataFrame([('{"a": 1}',), ('[{"a": 2}, {"a": 3}]',)], "t string"), "t", "a:int")
    assert sorted(r["a"] for r in notes.collect()) == [1, 2, 3]


def test_queries_jsonl_names_problems(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "q": "x", "gold": ["a"]}\n{"id": "2", "q": "x", "gold": []}\n{"id": "3", "gold": ["a"]}\n')
    got = {r["id"]: r["problem"] for r in parsers.queries_jsonl(spark, str(tmp_path / "q.jsonl")).collect()}
    assert got == {"1": None, "2": "empty gold", "3": "missing field"}


def test_code_symbols(spark):
    files = [("a.py", "class A(B):\n    def m(self):\n        return f(1)\n"), ("b.go", "func (s *S) Run() {\n}\ntype T struct {\n"), ("bad.py", "def ("), ("n.rs", None)]
    df = spark.createDataFrame(files, "path string, text string")
    got = {(r["path"], r["kind"], r["name"]) for r in code.analyze(df).collect()}
    assert got == {("a.py", "class", "A"), ("a.py", "method", "m"), ("b.go", "method", "Run"), ("b.go", "struct", "T")}
    assert {(r["src"], r["dst"], r["edge_type"]) for r in code.analyze(df, "edges").collect()} == {("A", "B", "extends"), ("m", "f", "calls")}


def test_redaction_keeps_keys(spark):
    assert one(spark, tx.redact(F.lit("password: hunter2, Bearer abc.def"))) == "password:[REDACTED] Bearer [REDACTED]"


def test_passages_meet_documents_without_a_nested_loop(spark):
    from siftwright.operators import evaluation

    texts = ["a bc def ghi jkl", "xa bc  def", "def", "the the the ghi jkl mno", None, "", "one two three four five", "tab\tsep words\nhere now", "éa bc def ghi jklm"]
    wanted = ["a bc def", "bc  def", "ghi jkl", "de", "j", "", " ", "the ghi jkl mno", "one two three four five", "sep words\nhere", "nothing like this here", None, "he", "bc def ghi", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    passages = spark.createDataFrame([(100 + i, w) for i, w in enumerate(wanted)], "item long, passage string")
    got = evaluation.holding(docs, passages)
    want = sorted((i, 100 + j) for i, t in enumerate(texts) for j, w in enumerate(wanted) if t is not None and w is not None and w in t)
    assert sorted((r["doc"], r["item"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_flows_are_whole_unless_capped(spark):
    """6,000 entries with one path each, and one entry with 60 leaves."""
    edges = spark.range(6000).selectExpr("id AS src", "id + 10000 AS dst").union(spark.range(60).selectExpr("99999L", "id + 50000"))
    entries = edges.select(F.col("src").alias("node")).distinct()
    found = graph.flows(edges, entries, max_depth=2)
    assert found.count() == 6060 and found.where("entry = 99999").count() == 60
    capped = graph.flows(edges, entries, max_depth=2, per_entry=50, total=5000).collect()
    assert [r["entry"] for r in capped] == list(range(5000))


def test_flows_are_followed_to_their_ends(spark, tmp_path):
    """Six hops over a chain of parts with a shorter way by the brand, where the
    query once ended paths after four; then 12 hops into a cycle, whose last new
    node is the leaf, where the operator once ended them after ten."""
    import duckdb

    parts = spark.range(40).selectExpr("id AS p_partkey", "IF(id < 12, 1, 30) AS p_size", "IF(id IN (3, 30), 'Brand#11', 'Brand#12') AS p_brand")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES["flows"](spark, str(tmp_path)).toPandas()
    assert list(got.sort_values("entry")["path"]) == ["0>1>2>3>10>11>12", "30>37"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert_same(got, con.sql(catalog.SQL["flows"]).df())
    edges = spark.range(13).selectExpr("id AS src", "IF(id = 12, 1, id + 1) AS dst")
    found = graph.flows(edges, spark.range(1).toDF("node")).collect()
    assert [(r["entry"], r["leaf"], r["path"]) for r in found] == [(0, 12, list(range(13)))]


def test_every_node_of_a_flow_has_its_label(spark):
    edges = spark.range(6000).selectExpr("id AS src", "id + 10000 AS dst")
    found = graph.flows(edges, edges.select(F.col("src").alias("node")), max_depth=2)
    items = edges.select(F.col("dst").alias("k"))
    labelled = packs.flow_label(items, found, "k")
    assert labelled.where("flow = concat(k - 10000, '>', k)").count() == 6000
