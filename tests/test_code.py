"""Analyzers: bracket languages, odd texts, the registry."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from siftwright.sources import analyzers, brackets, code

JAVA = """package a;
import static org.junit.Assert.assertTrue;

/**
 * Tests { users.
 */
@RunWith(X.class)
public class UserServiceTest<T extends B> extends a.b.Base<T, C> implements Runnable, Closeable {
    int x = make(3);
    char c = '}';
    public UserServiceTest(int a) { super(a); init(); }
    @Test
    @DisplayName("}")
    public void testIt(List<String> a) throws E {
        if (a.isEmpty()) { return; }
        a.forEach(y -> { run(y); });
        new Other(1).go();
    }
    abstract int size();
    enum Color { RED(1), GREEN(2); Color(int n) {} }
    interface Inner extends P, Q { void go(); }
    @interface Mark {}
}
"""


def named(out):
    return [(s.kind, s.name, s.line_start, s.line_end, s.owner) for s in out.symbols]


def test_java():
    out = brackets.outline("src/UserServiceTest.java", JAVA, "java")
    assert named(out) == [
        ("class", "UserServiceTest", 7, 23, None), ("constructor", "UserServiceTest", 11, 11, "UserServiceTest"), ("method", "testIt", 12, 18, "UserServiceTest"),
        ("method", "size", 19, 19, "UserServiceTest"), ("enum", "Color", 20, 20, "UserServiceTest"), ("constructor", "Color", 20, 20, "Color"),
        ("interface", "Inner", 21, 21, "UserServiceTest"), ("method", "go", 21, 21, "Inner"), ("annotation", "Mark", 22, 22, "UserServiceTest"),
    ]
    assert out.symbols[0].docstring == "Tests { users." and out.symbols[2].signature.startswith("@Test @DisplayName public void testIt(")
    assert set(out.edges) == {
        ("src/UserServiceTest.java", "assertTrue", "imports"), ("UserServiceTest", "Base", "extends"), ("UserServiceTest", "Runnable", "implements"), ("UserServiceTest", "Closeable", "implements"),
        ("UserServiceTest", "init", "calls"), ("UserService", "testIt", "tested_by"), ("testIt", "isEmpty", "calls"), ("testIt", "forEach", "calls"), ("testIt", "run", "calls"), ("testIt", "go", "calls"),
        ("Inner", "P", "extends"), ("Inner", "Q", "extends"),
    }


def test_go_groups_and_receivers():
    text = 'import (\n\t"fmt"\n\tx "os/exec"\n)\ntype (\n\tA int\n\tB interface {\n\t\tGo()\n\t}\n)\nfunc (s *Server) Run() { s.a(); fmt.Println("}") }\nfunc Map[T any](f func(T) T) T {\n\treturn f(1)\n}\n'
    out = brackets.outline("m.go", text, "go")
    assert named(out) == [("type", "A", 6, 6, None), ("interface", "B", 7, 9, None), ("method", "Run", 11, 11, "Server"), ("function", "Map", 12, 14, None)]
    assert [e for e in out.edges if e[2] == "imports"] == [("m.go", "fmt", "imports"), ("m.go", "os/exec", "imports")]


def test_typescript_functions_and_type_aliases():
    text = "type Al = { a: string }\nexport const f = async (q: number) => {\n  return g(q)\n}\nexport default function main() { f(1); [1].map((x) => { inner(x) }) }\ninterface P extends Q, R { b(): void }\n"
    out = brackets.outline("a.ts", text, "ts")
    assert named(out) == [("type", "Al", 1, 1, None), ("function", "f", 2, 4, None), ("function", "main", 5, 5, None), ("interface", "P", 6, 6, None)]
    assert {("f", "g", "calls"), ("main", "inner", "calls"), ("P", "Q", "extends"), ("P", "R", "extends")} <= set(out.edges)


def test_csharp_namespaces_and_bases():
    text = "using System.Text;\nnamespace My.App;\ninterface IThing : IBase { void Go(); }\nrecord Pt(int X) : Base(X), IOne;\nclass C : IOne, ITwo { public string Name { get; set; } int Calc() => Add(1); }\n"
    out = brackets.outline("c.cs", text, "cs")
    assert ("namespace", "My.App", 2, 6, None) in named(out) or ("namespace", "My.App", 2, 5, None) in named(out)
    assert {("IThing", "IBase", "extends"), ("Pt", "Base", "extends"), ("Pt", "IOne", "implements"), ("C", "IOne", "implements"), ("C", "ITwo", "implements"), ("c.cs", "Text", "imports")} == {e for e in out.edges if e[2] != "calls"}
    assert [s[:2] for s in named(out)][-3:] == [("class", "C"), ("property", "Name"), ("method", "Calc")]


def test_rust_and_php():
    rust = brackets.outline("l.rs", "use a::{B, c::D};\nstruct Unit;\ntrait S: T { fn a(&self); }\nimpl<T> S for Unit where T: X { fn a(&self) { b(r#\"}\"#) } }\n", "rs")
    assert named(rust) == [("struct", "Unit", 2, 2, None), ("trait", "S", 3, 3, None), ("function", "a", 3, 3, "S"), ("method", "a", 4, 4, "Unit")]
    assert set(rust.edges) == {("l.rs", "B", "imports"), ("l.rs", "D", "imports"), ("S", "T", "extends"), ("Unit", "S", "implements"), ("a", "b", "calls")}
    php = brackets.outline("l.php", "<?php\nuse A\\B;\nclass X extends Y {\n  # }\n  function go($a) { return $this->run('}'); }\n}\n", "php")
    assert named(php) == [("class", "X", 3, 6, None), ("method", "go", 5, 5, "X")]


@pytest.mark.parametrize("language", sorted(brackets.LANGUAGES))
def test_any_text_is_read_in_linear_time(language):
    rng = random.Random(1)
    pieces = ["class A ", "{", "}", "(", ")", "[", "]", '"', "'", "`", "/*", "*/", "//", "\n", ";", "fn f", "func (", "import ", "use ", "=>", "=", ":", "@", "#", "é", "type ", "namespace ", "impl ", "\\", "$x", "<", ">", ",", "1.5"]
    for n in range(400):
        brackets.outline("x." + language, "".join(rng.choice(pieces) for _ in range(n % 60)), language)
    brackets.outline("x." + language, "void f() { g(); }\n" * 20_000 + "{" * 50_000, language)


def test_registry():
    class Own:
        def rows(self, path, text):
            return [], []

    def broken():
        raise RuntimeError("no maker")

    r = analyzers.Registry()
    first = Own()
    assert r.register("py", lambda: first) and not r.register("py", code.PythonFiles) and not r.register("a", broken) and not r.register("b", dict)
    assert r.found["py"] is first and r.extensions() == ["py"] and r.errors == [("a", "RuntimeError: no maker"), ("b", "dict is no analyzer")]

    class Point:
        name = "zz"

        def load(self):
            return Own

    r.discover([Point(), Point()])
    assert r.extensions() == ["py", "zz"]


def test_files_of_all_kinds(spark):
    rows = [("a/b.py", "class A(B):\n  '''Doc.'''\n  def f(self): return g()\n"), ("bad.py", "def ("), ("x.unknown", "def f"), ("noext", "x"), (None, None), ("n.java", None), ("k.kt", "class K { }"), ("e.PY", "import os")]
    indexed = analyzers.index(spark.createDataFrame(rows, "path string, text string"), code.built_in())
    assert indexed.count() == len(rows)
    assert {tuple(r) for r in analyzers.parts(indexed, "symbols").select("path", "kind", "name", "owner", "docstring").collect()} == {("a/b.py", "class", "A", None, "Doc."), ("a/b.py", "method", "f", "A", ""), ("k.kt", "class", "K", None, "")}
    assert {tuple(r) for r in analyzers.parts(indexed, "edges").select("src", "dst", "edge_type").collect()} == {("A", "B", "extends"), ("f", "g", "calls"), ("e.PY", "os", "imports")}
    assert [r["path"] for r in analyzers.parts(indexed, "errors").collect()] == ["bad.py"]


def test_files_of_one_small_partition_are_analyzed_by_many_tasks(spark):
    files = spark.range(0, 4000, 1, 1).selectExpr("concat('f', id, '.rb') AS path", "concat('class C', id) AS text")
    found = code.analyze(files).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(found) >= 4 and sum(r["n"] for r in found) == 4000 and max(r["n"] for r in found) < 1500


def test_plain_statements_cost_few_calls():
    """1,000 lines of seven tokens each; calls, not seconds, are counted."""
    text = "class A { void f() {\n" + "    a += 1; // {\n" * 1000 + "} }"
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        out = brackets.outline("A.java", text, "java")
    finally:
        sys.setprofile(None)
    assert named(out) == [("class", "A", 1, 1002, None), ("method", "f", 1, 1002, "A")]
    assert calls < 10_000


def test_kinds_of_tokens():
    def kinds(text, language):
        return [(t.kind, t.text, t.line) for t in brackets.tokens(text, brackets.LANGUAGES[language])]

    assert kinds("#[A]\n# c\n#\n$x '\n'", "php") == [
        ("mark", "#", 1), ("mark", "[", 1), ("word", "A", 1), ("mark", "]", 1), ("line", "\n", 1), ("note", "# c", 2), ("line", "\n", 2), ("note", "#", 3), ("line", "\n", 3), ("word", "$x", 4), ("text", "'\n'", 4),
    ]
    assert kinds("b'x' r#\"\"\"# br 'a #\"", "rs") == [("text", "b'x'", 1), ("text", "r#\"\"\"#", 1), ("word", "br", 1), ("mark", "'", 1), ("word", "a", 1), ("mark", "#", 1), ("mark", '"', 1)]
    assert kinds('$"a" $@"\n" @ /* \n */ x', "cs") == [("text", '$"a"', 1), ("text", '$@"\n"', 1), ("mark", "@", 2), ("note", "/* \n */", 2), ("word", "x", 3)]
    assert kinds("= /a/g / 1.5 => ²٣", "ts") == [("mark", "=", 1), ("text", " /a/g", 1), ("mark", "/", 1), ("number", "1.5", 1), ("mark", "=>", 1), ("word", "²٣", 1)]


def test_rows_of_plug_ins_may_be_short_or_long():
    found = analyzers.lists([[("a", "b")], [], [("c", "d", "e", "f"), ["g", "h", "i"]]], analyzers.kinds_of(analyzers.EDGE)).to_pylist()
    assert [[tuple(r.values()) for r in rows] for rows in found] == [[("a", "b", None)], [], [("c", "d", "e"), ("g", "h", "i")]]
    assert analyzers.lists([[], []], analyzers.kinds_of(analyzers.SYMBOL)).to_pylist() == [[], []]
